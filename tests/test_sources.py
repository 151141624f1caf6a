"""Readers, writers and the incremental jobs on literal files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from schedlake.operators import publish as P
from schedlake.operators import reconcile as R
from schedlake.operators.normalize import ENTRIES
from schedlake.sources import readers, sinks
from schedlake.streaming.landing import land_changes, land_files, publish_stream


def put(path, obj, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False)).encode(encoding))
    return str(path)


def test_envelope(spark, tmp_path):
    p = put(tmp_path / "a.json", {"city": "市", "source": "s", "fetched_at": "2026-07-01", "records": [{"area": "中區", "g_d1_time_s": "9:00"}, {"area": None}]})
    rows = readers.envelope(spark, p, readers.WIDE_DAYS).collect()
    assert [(r.env_city, r.area, r.g_d1_time_s) for r in rows] == [("市", "中區", "9:00"), ("市", None, None)]


def test_stop_files_and_routes(spark, tmp_path):
    stop = {"poi_id": 7, "poi_name": "路", "show_arrive_time": "星期一：08:00", "lat": 24.5}
    put(tmp_path / "s/g1__g1_2__lagi.json", {"errCode": "0", "result": [stop, {**stop, "poi_id": 8}]})
    put(tmp_path / "s/g1__g1_2__recycle.json", {"result": []})
    put(tmp_path / "s/g1__g1_2__other.json", {"result": [stop]})
    rows = readers.stop_files(spark, str(tmp_path / "s")).collect()
    assert sorted((r.file_gid, r.route_id, r.car_type, r.poi_id) for r in rows) == [("g1", "g1_2", "lagi", 7), ("g1", "g1_2", "lagi", 8)]
    assert all(r.fetched_at.endswith("T00:00:00+08:00") for r in rows)
    put(tmp_path / "r/d1.json", {"result": [{"routing_id": "a", "run_type": "1"}, {"routing_id": "b", "run_type": "2"}]})
    put(tmp_path / "r/d2.json", {"result": [{"routing_id": "a", "run_type": "3"}]})
    got = {r.routing_id: (r.district_gid, r.run_type) for r in readers.route_lists(spark, str(tmp_path / "r")).collect()}
    assert got == {"a": ("d2", "3"), "b": ("d1", "2")}


def test_office_calendar(spark, tmp_path):
    p = put(tmp_path / "c.csv", "﻿西元日期,星期,是否放假,備註\n20260101,四,2,開國紀念日\n20260102, 五 ,0,\n")
    rows = readers.office_calendar(spark, p).orderBy("d").collect()
    assert [(r.d, r.weekday, r.weekday_char, r.is_holiday, r.memo) for r in rows] == [
        (dt.date(2026, 1, 1), 4, "四", True, "開國紀念日"), (dt.date(2026, 1, 2), 5, "五", False, "")
    ]
    bad = put(tmp_path / "bad.csv", "西元日期,星期,放假,備註\n20260101,四,2,x\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.office_calendar(spark, bad).collect()


def test_shift_jis_holidays(spark, tmp_path):
    p = put(tmp_path / "jp.csv", "国民の祝日・休日月日,国民の祝日・休日名称\r\n2026/1/1,元日\r\n2025/12/31,x\r\n2026/11/23,勤労感謝の日\r\n", "cp932")
    got = [(str(r.d), r.name) for r in readers.jp_holidays(spark, p, [2026, 2027]).orderBy("d").collect()]
    assert got == [("2026-01-01", "元日"), ("2026-11-23", "勤労感謝の日")]


def test_yearly_holidays(spark, tmp_path):
    a = put(tmp_path / "a.csv", "date,day,holiday\n2026-01-01,Thursday,New Year\n")
    b = put(tmp_path / "b.csv", "date,day,holiday\n2027-01-01,Friday,New Year\n")
    assert readers.sg_holidays(spark, {2026: a, 2027: b}).count() == 2
    wrong = put(tmp_path / "w.csv", "date,day,holiday\n2026-01-01,Friday,New Year\n")
    with pytest.raises(Exception, match="inconsistent"):
        readers.sg_holidays(spark, {2026: wrong}).collect()


def test_small_documents(spark, tmp_path):
    p = put(tmp_path / "m.json", {"data": {"datasetId": "d", "name": "n", "managedBy": "m", "lastUpdatedAt": "t"}})
    assert tuple(readers.holiday_metadata(spark, p).first()) == ("d", "n", "m", "t")
    p = put(tmp_path / "h.json", {"country": "jp", "holidays": [{"d": "2026-01-01", "name": "元日"}]})
    assert readers.holiday_documents(spark, p).first().d == dt.date(2026, 1, 1)
    p = put(tmp_path / "l.csv", "solar_date,lunar_year,lunar_month,lunar_day,is_leap_month,lunar_month_label,lunar_day_label,ganzhi,zodiac,solar_term\n2025-07-25,2025,6,1,true,閏六月,初一,乙巳,蛇,\n")
    r = readers.lunar_days(spark, p).first()
    assert (r.is_leap_month, r.solar_term, r.lunar_month) == (True, "", 6)


def points(spark, rows):
    entry = [([1], "08:00", None)]
    data = [(c, "區", "d", f"X-D-{i}", "名", 24.0, 121.0, entry, [], v) for c, i, v in rows]
    schema = f"city_slug string, district string, district_slug string, point_id string, point_name string, lat double, lng double, schedule {ENTRIES}, recycling_schedule {ENTRIES}, v int"
    return spark.createDataFrame(data, schema).withColumn("city", F.col("city_slug")).withColumn("foodscraps_schedule", F.col("recycling_schedule"))


def tagged(df):
    add = lambda c: F.transform(c, lambda e: F.struct(e["weekday"], e["arrive"], e["depart"], F.lit("listed").alias("weekday_source")))
    for c in ("schedule", "recycling_schedule", "foodscraps_schedule"):
        df = df.withColumn(c, add(c))
    return df


def test_publish_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "points")
    arrays = ["schedule", "recycling_schedule", "foodscraps_schedule"]
    base = spark.createDataFrame([("a", 2, "t0"), ("b", 2, "t0")], "city_slug string, count bigint, updated_at string")
    sinks.publish(tagged(points(spark, [("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("b", 4, 1)])), base, path, "city_slug", arrays, "t1")
    _, new_base = sinks.publish(tagged(points(spark, [("a", 1, 2), ("a", 9, 2)])), base, path, "city_slug", arrays, "t2")
    read = lambda: sorted((r.city_slug, r.point_id, r.v) for r in spark.read.parquet(path).collect())
    want = [("a", "X-D-1", 2), ("a", "X-D-9", 2), ("b", "X-D-3", 1), ("b", "X-D-4", 1)]
    assert read() == want
    assert {r.city_slug: r.updated_at for r in new_base.collect()} == {"a": "t2", "b": "t0"}
    # a change of more than 30 % fails the gate before anything is written
    with pytest.raises(ValueError, match="a"):
        sinks.publish(tagged(points(spark, [("a", i, 3) for i in range(9)])), base, path, "city_slug", arrays, "t3")
    assert read() == want
    assert readers.publishable_points(spark, path).count() == 4


def test_versions(spark, tmp_path):
    path = str(tmp_path / "ids")
    for version, n in (("2026-04", 1), ("2026-07", 2)):
        sinks.write_version(spark.range(n), path, version)
    assert readers.snapshot(spark, path).count() == 2
    assert readers.snapshot(spark, path, "2026-04").count() == 1


def test_text_sinks(spark, tmp_path):
    d = spark.createDataFrame([(dt.date(2026, 12, 31), True, "a,b"), (dt.date(2026, 1, 3), True, "")], "d date, is_holiday boolean, memo string")
    events = P.calendar_events(d, "example.org", "see ")
    r = events.first()
    assert (r.dtstart, r.dtend, r.summary) == ("20261231", "20270101", "a\\,b") and events.count() == 1
    sinks.write_events(events, str(tmp_path / "e"))
    assert "DTEND;VALUE=DATE:20270101" in "".join(f.read_text() for f in (tmp_path / "e").glob("part*"))
    sinks.write_csv(d, str(tmp_path / "c"), ["memo", "is_holiday", "d"], ["d"])
    assert "memo,is_holiday,d" in "".join(f.read_text() for f in (tmp_path / "c").glob("part*"))
    lines = spark.createDataFrame([("https://x/?a=1&b=2", "2026-01-01"), ("https://y", None)], "loc string, lastmod string").withColumn("line", P.sitemap_line())
    sinks.write_lines(lines, "line", str(tmp_path / "s"))
    text = "".join(f.read_text() for f in (tmp_path / "s").glob("part*"))
    assert "<loc>https://x/?a=1&amp;b=2</loc><lastmod>2026-01-01</lastmod>" in text and "<url><loc>https://y</loc></url>" in text


def test_remaining_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "d", "1", "N1"), ("b", "d", "2", "N2")], "city_slug string, district_slug string, old_slug string, new_point_id string")
    sinks.write_redirects(rows, str(tmp_path / "r"))
    sinks.write_redirects(rows.filter("city_slug = 'a'").withColumn("new_point_id", F.lit("N9")), str(tmp_path / "r"))
    assert {(r.city_slug, r.new_point_id) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {("a", "N9"), ("b", "N2")}
    sinks.write_documents(spark.createDataFrame([("x", [1, 2])], "name string, days array<int>"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().days == [1, 2]
    sinks.write_index(rows, rows.select("city_slug").distinct(), rows.select("district_slug").distinct(), str(tmp_path / "i"))
    assert [spark.read.json(str(tmp_path / "i" / n)).count() for n in ("points", "cities", "districts")] == [2, 2, 1]
    for _ in range(2):
        sinks.write_report(spark.createDataFrame([("a", True)], "city_slug string, passed boolean"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    report = spark.createDataFrame([("a", True), ("b", False)], "city_slug string, passed boolean")
    fresh = tagged(points(spark, [("a", 1, 2), ("b", 2, 2)]))
    arrays = ["schedule", "recycling_schedule", "foodscraps_schedule"]
    sinks.publish_passing(fresh, report, str(tmp_path / "q"), "city_slug", arrays)
    assert [r.city_slug for r in spark.read.parquet(str(tmp_path / "q")).collect()] == ["a"]
    p = put(tmp_path / "seg.json", '{"start": "2025-07-25", "year_name": "乙巳", "month": "六", "leap": 1, "first_day": 1, "days": 29}\n')
    assert readers.lunar_segments(spark, p).first().month_label == "閏六"


def test_landing_reads_each_file_once(spark, tmp_path):
    src, sink, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(src / "a.json", '{"k": 1}\n{"k": 2}\n')
    assert land_files(spark, str(src), "k int", "json", sink, check) == 2
    assert land_files(spark, str(src), "k int", "json", sink, check) == 0
    put(src / "b.json", '{"k": 3}\n')
    assert land_files(spark, str(src), "k int", "json", sink, check) == 1
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_publish_stream_touches_only_its_partitions(spark, tmp_path):
    path, src = str(tmp_path / "points"), tmp_path / "in"
    frame = lambda rows: spark.createDataFrame(rows, "city_slug string, district_slug string, point_id string, v int")
    sinks.write_points(frame([("a", "d", "1", 1), ("b", "d", "2", 1)]), path)
    put(src / "x.json", '{"city_slug": "b", "district_slug": "d", "point_id": "3", "v": 2}\n')
    stream = spark.readStream.schema("city_slug string, district_slug string, point_id string, v int").json(str(src))
    assert publish_stream(stream, path, str(tmp_path / "check")) == 1
    assert sorted((r.city_slug, r.point_id) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "3")]
    assert publish_stream(stream, path, str(tmp_path / "check")) == 0


def test_publish_stream_keeps_a_city_that_spans_batches(spark, tmp_path):
    path, src = str(tmp_path / "points"), tmp_path / "in"
    row = '{"city_slug": "b", "district_slug": "d", "point_id": "%s", "v": 2}\n'
    put(src / "x.json", row % "1")
    put(src / "y.json", row % "2")
    put(src / "z.json", row % "3")
    schema = "city_slug string, district_slug string, point_id string, v int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    assert publish_stream(stream, path, str(tmp_path / "check")) == 3
    assert sorted(r.point_id for r in spark.read.parquet(path).collect()) == ["1", "2", "3"]


def test_landing_counts_more_batches_than_the_progress_list_keeps(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(6):
        put(src / f"{i}.json", '{"k": 1}\n{"k": 2}\n')
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).json(str(src))
        from schedlake.streaming.landing import _landed

        assert sum(_landed(stream, str(tmp_path / "out"), str(tmp_path / "check"))) == 12
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_envelope_of_several_documents(spark, tmp_path):
    for i, areas in enumerate((["a", "b"], [], ["c", "d", "e"])):
        put(tmp_path / f"{i}.json", {"city": "市", "source": "s", "fetched_at": "t", "records": [{"area": a} for a in areas]})
    rows = readers.envelope(spark, str(tmp_path), readers.WIDE_DAYS).collect()
    assert sorted((r["ord"], r.area) for r in rows) == list(enumerate("abcde"))


def test_lookup_of_a_slug_that_two_cities_share(spark):
    points = spark.createDataFrame(
        [("TYN-LUZHU-1", "甲", "蘆竹區", "luzhu"), ("KHH-LUZHU-2", "乙", "路竹區", "luzhu")], "point_id string, point_name string, district string, district_slug string")
    asked = spark.createDataFrame([(1, "KHH-LUZHU-ZZ"), (2, "TYN-LUZHU-1"), (3, "TXG-LUZHU-9")], "n int, point_id string")
    got = {r.n: (r.found, r.district_name) for r in R.lookup_points(asked, points).collect()}
    assert got == {1: (False, "路竹區"), 2: (True, "蘆竹區"), 3: (False, None)}


def test_publish_holds_back_rows_and_survives_reading_its_target(spark, tmp_path):
    path = str(tmp_path / "points")
    arrays = ["schedule", "recycling_schedule", "foodscraps_schedule"]
    base = spark.createDataFrame([], "city_slug string, count bigint, updated_at string")
    rows = tagged(points(spark, [("a", i, 1) for i in range(40)]))
    nameless = rows.limit(1).withColumn("point_name", F.lit(None).cast("string")).withColumn("point_id", F.lit("X-D-none"))
    sinks.publish(rows.unionByName(nameless), base, path, "city_slug", arrays, "t1")
    written = spark.read.parquet(path)
    assert written.count() == 40 and written.filter("point_name is null").count() == 0
    assert "weekday_source" not in written.schema["schedule"].simpleString()
    _, new_base = sinks.publish(tagged(written.withColumn("recycling_schedule", F.coalesce("recycling_schedule", F.expr("array()").cast(ENTRIES))).withColumn(
        "foodscraps_schedule", F.coalesce("foodscraps_schedule", F.expr("array()").cast(ENTRIES)))), base, path, "city_slug", arrays, "t2")
    assert [(r.city_slug, r["count"], r.updated_at) for r in new_base.collect()] == [("a", 40, "t2")]
    assert spark.read.parquet(path).count() == 40


def test_newest_version_compares_numbers(spark, tmp_path):
    path = str(tmp_path / "ids")
    for version, n in (("9", 1), ("10", 2)):
        sinks.write_version(spark.range(n), path, version)
    assert readers.snapshot(spark, path).count() == 2
    sinks.write_version(spark.range(3), path, "latest")
    with pytest.raises(Exception, match="not a version"):
        readers.snapshot(spark, path)


def test_reconcile_rules(spark):
    schema = "ord bigint, village string, point_name string, point_id string, sig string"
    old = [(1, "v", "one", "A-D-1", "s"), (2, None, "pair", "A-D-2", "s1"), (3, None, "pair", "A-D-3", "s2"), (4, "v", "same", "A-D-4", "s"), (5, "v", "same", "A-D-5", "s"),
           (6, "v", "gone", "A-D-6", "s"), (7, "v", "more", "A-D-7", "s"), (8, "v", "bad", "A", "s"), (9, "v", "dup", "A-D-9", "s1"), (10, "v", "dup", "A-D-10", "s1")]
    new = [(1, "v", "one", "N1", "other"), (2, "", "pair", "N2", "s2"), (3, "", "pair", "N3", "s1"), (4, "v", "same", "N4", "s"), (5, "v", "same", "N5", "s"),
           (7, "v", "more", "N7", "s"), (71, "v", "more", "N71", "t"), (8, "v", "bad", "N8", "s"), (9, "v", "dup", "N9", "s1"), (10, "v", "dup", "N10", "s2")]
    got = R.reconcile(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    rows = {r["ord"]: (r.status, r.new_point_id) for r in got.collect()}
    assert rows[1] == ("matched", "N1") and rows[2] == ("matched", "N3") and rows[3] == ("matched", "N2")
    assert rows[4] == rows[5] == ("ambiguous", None) and rows[6] == ("unmatched", None) and rows[7] == ("ambiguous", None) and rows[8] == ("unmatched", None)
    # two old rows of one signature share the new one
    assert rows[9] == rows[10] == ("matched", "N9")
    s = R.reconcile_stats(got).first()
    assert (s.old_total, s.matched_unique, s.ambiguous_skipped, s.ambiguous_groups, s.unmatched_no_key) == (10, 5, 3, 2, 2)


def test_publish_stored_survives_stops(spark, tmp_path, monkeypatch):
    """Stopped before the run counts: nothing changes. Stopped after: the next publish finishes it. Data and baseline agree always."""
    path, arrays = str(tmp_path / "points"), ["schedule", "recycling_schedule", "foodscraps_schedule"]
    read = lambda: sorted((r.city_slug, r.point_id, r.v) for r in spark.read.parquet(path).collect())
    base = lambda: {r.city_slug: (r["count"], r.updated_at) for r in sinks.stored_baseline(spark, path, "city_slug").collect()}
    new = lambda rows: tagged(points(spark, rows))
    put = lambda rows, at: sinks.publish_stored(new(rows), path, "city_slug", arrays, at)
    assert base() == {} and sinks.recover(spark, path, "city_slug") == []
    put([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 3, 1), ("b", 4, 1)], "t1")
    first = read()
    assert base() == {"a": (3, "t1"), "b": (2, "t1")}

    def stop(*_):
        raise RuntimeError("stopped")

    note, write = sinks._note, sinks.write_points
    monkeypatch.setattr(sinks, "_note", stop)
    with pytest.raises(RuntimeError):
        put([("a", 7, 2), ("a", 8, 2), ("a", 9, 2)], "t2")
    monkeypatch.setattr(sinks, "_note", note)
    assert read() == first and base() == {"a": (3, "t1"), "b": (2, "t1")}

    monkeypatch.setattr(sinks, "write_points", stop)
    with pytest.raises(RuntimeError):
        put([("a", 5, 3), ("a", 6, 3), ("a", 9, 3)], "t3")
    monkeypatch.setattr(sinks, "write_points", write)
    assert read() == first and base()["a"] == (3, "t3")
    # the gate of the next publish sees the baseline of the stopped run, whose rows it puts in place first
    with pytest.raises(ValueError, match="b"):
        put([("b", i, 4) for i in range(9)], "t4")
    assert read() == [("a", f"X-D-{i}", 3) for i in (5, 6, 9)] + [("b", "X-D-3", 1), ("b", "X-D-4", 1)]
    put([("b", 3, 5), ("b", 8, 5)], "t5")
    assert base() == {"a": (3, "t3"), "b": (2, "t5")} and [r for r in read() if r[0] == "b"] == [("b", "X-D-3", 5), ("b", "X-D-8", 5)]
    sinks.drop_finished(spark, path)
    assert base() == {"a": (3, "t3"), "b": (2, "t5")} and sinks.recover(spark, path, "city_slug") == []
    put([("a", 1, 6), ("a", 2, 6), ("a", 3, 6)], "t6")
    assert base()["a"] == (3, "t6")


VERSIONS = "id string, a string, b string, version long"


def changes_between(snapshots):
    """Plain comparison of each version with the one before."""
    out, before = set(), {}
    for number, rows in enumerate(snapshots, start=1):
        now = {r[0]: r[1:] for r in rows if r[0] is not None}
        out |= {(k, number, "added") for k in now if k not in before} | {(k, number, "removed") for k in before if k not in now}
        out |= {(k, number, "changed") for k in now if k in before and now[k] != before[k]}
        before = now
    return out


def write_versions(spark, source, snapshots, first=1):
    for number, rows in enumerate(snapshots, start=first):
        spark.createDataFrame(rows, "id string, a string, b string").repartition(3).write.parquet(f"{source}/version={number}")


def landed_changes(spark, sink):
    rows = [tuple(r) for r in spark.read.schema("id string, version long, status string").parquet(sink).select("id", "version", "status").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_change_stream_over_several_runs(spark, tmp_path):
    rng = random.Random(4)
    snapshots = [[(f"k{i}", rng.choice("xy"), rng.choice(["u", None])) for i in range(60) if rng.random() < 0.7] + [(None, "x", "u")] * 2 for _ in range(6)]
    snapshots[2] = []  # everything goes and comes back
    snapshots[4] = [(k, b, a) for k, a, b in snapshots[3]]  # values change places, nulls included
    source, sink, check = (str(tmp_path / x) for x in ("source", "sink", "check"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    done = 0
    for upto in (1, 2, 5, 6):
        write_versions(spark, source, snapshots[done:upto], done + 1)
        land_changes(spark, source, VERSIONS, sink, check, "id", ["a", "b"])
        done = upto
        want = {c for c in changes_between(snapshots[:upto])}
        assert landed_changes(spark, sink) == want
    assert land_changes(spark, source, VERSIONS, sink, check, "id", ["a", "b"]) == 0
    assert landed_changes(spark, sink) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_change_stream_does_not_read_old_versions_and_survives_a_lost_commit(spark, tmp_path):
    snapshots = [[("a", "x", None), ("b", "x", None)], [("b", "y", None), ("c", "x", None)], [("c", "x", None)]]
    source, sink, check = (str(tmp_path / x) for x in ("source", "sink", "check"))
    write_versions(spark, source, snapshots[:2])
    land_changes(spark, source, VERSIONS, sink, check, "id", ["a", "b"])
    for old in (tmp_path / "source").glob("version=*/*.parquet"):
        old.write_bytes(b"no longer readable")
    write_versions(spark, source, snapshots[2:], 3)
    land_changes(spark, source, VERSIONS, sink, check, "id", ["a", "b"])
    assert landed_changes(spark, sink) == changes_between(snapshots)
    # a job lost after its last batch was written and before it was recorded repeats the batch
    last = max(int(x.name) for x in (tmp_path / "check" / "commits").iterdir() if x.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    land_changes(spark, source, VERSIONS, sink, check, "id", ["a", "b"])
    assert landed_changes(spark, sink) == changes_between(snapshots)


def opened_files(df):
    """Files that the scans of a finished query were given."""

    def leaves(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return leaves(node.executedPlan())
        below = node.children()
        return [x for i in range(below.size()) for x in leaves(below.apply(i))] if below.size() else [node]

    df.collect()
    counts = [x.metrics().get("numFiles") for x in leaves(df._jdf.queryExecution().executedPlan())]
    return sum(c.get().value() for c in counts if c.isDefined())


def test_stop_files_of_other_keys_are_not_opened(spark, tmp_path):
    for gid in "ABCD":
        for route in (1, 2, 3):
            content = {"errCode": "", "msg": "", "result": [{"gid": gid, "poi_id": route, "poi_name": "p"}]}
            (tmp_path / f"{gid}__{route}__{'lagi' if route < 3 else 'recycle'}.json").write_text(json.dumps(content))
    every = readers.stop_files(spark, str(tmp_path))
    assert opened_files(every) == 12
    assert opened_files(every.filter("file_gid = 'B'")) == 3
    assert opened_files(every.filter("file_gid IN ('A', 'C') AND route_id = '2'")) == 2
    assert opened_files(every.filter("car_type = 'recycle'")) == 4
    assert [(r.file_gid, r.poi_id) for r in every.filter("file_gid = 'D' AND car_type = 'recycle'").collect()] == [("D", 3)]
