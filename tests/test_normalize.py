"""Normalising functions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from schedlake.functions import dates, geo, text, times
from schedlake.operators import content as T
from schedlake.operators import normalize as N
from schedlake.operators import quality as Q
from schedlake.operators import service as S
from schedlake.plans.normalising import entries_text


def values(spark, rows, fn, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(fn(*[F.col(c) for c in df.columns])).collect()]


def test_clock_tokens(spark):
    raw = ["9:05", " 18：47 ", "23:59", "24:00", "7:5", "", None, "1805", "　8:00"]
    assert values(spark, raw, times.clock) == ["09:05", "18:47", "23:59", None, None, None, None, None, "08:00"]
    assert values(spark, ["18:47", "x", "1:2:3", "9:x", None], times.minutes) == [1127, None, None, None, None]
    assert values(spark, ["18:47", "9:05", "24:00", None], times.is_clock) == [True, False, False, False]


def test_run_mask(spark):
    got = values(spark, ["2000000", "0221222", "022", None, "0000000"], times.run_mask_days)
    assert got == [[7], [1, 2, 4, 5, 6], [], [], []]


def test_clean_and_address(spark):
    assert values(spark, [" a ", "　", None, "\t"], text.clean) == ["a", None, None, None]
    rows = spark.createDataFrame([("市", None), ("市", "路")], "a string, b string")
    assert [r[0] for r in rows.select(text.address(rows.a, rows.b)).collect()] == [None, "市路"]


def test_search_text(spark):
    assert values(spark, ["臺中市 三民區,大連街", "ＡＢ１２　路", "x-Y_z!"], text.search_text) == ["台中市三民區大連街", "ab12路", "xyz"]


def test_rolling_hash_and_escape(spark):
    assert values(spark, ["TYN", ""], text.rolling_hash) == [83561, 0]
    assert values(spark, ["a\\,;\nb"], text.event_text_escape) == ["a\\\\\\,\\;\\nb"]
    assert values(spark, ["<&\"'>"], text.xml_escape) == ["&lt;&amp;&quot;&apos;&gt;"]


def test_roc_date_and_labels(spark):
    assert values(spark, ["115年07月21日", "115年13月01日", "下載", None], dates.roc_date) == [dt.date(2026, 7, 21), None, None, None]
    assert values(spark, ["一月十五", "十二月初一", "十一月初一"], dates.folk_month) == ["正月十五", "臘月初一", "十一月初一"]
    d = spark.createDataFrame([(dt.date(2026, 5, 3),)], "d date")
    assert tuple(d.select(dates.short_date(d.d), dates.date_line(d.d), dates.iso_weekday(d.d)).first()) == ("5/3(日)", "今天:2026/05/03 週日", 7)


def test_closure_window(spark):
    df = spark.createDataFrame([(dt.date(2029, 12, 28),), (dt.date(2029, 12, 29),), (dt.date(2030, 1, 1),), (dt.date(2030, 1, 3),), (dt.date(2030, 1, 4),)], "d date")
    got = [r[0] for r in df.select(dates.in_wrapping_window(df.d, F.lit("12-29"), F.lit("01-03"))).collect()]
    assert got == [False, True, True, True, False]


def test_coords(spark):
    raw = spark.createDataFrame([("24.5", "121"), ("bad", "121"), ("24.5", "bad"), ("", ""), (None, "121")], "a string, b string")
    got = [tuple(r) for r in raw.select(*geo.parse_coords(raw.a, raw.b)).collect()]
    assert got == [(24.5, 121.0, False), (None, None, True), (24.5, None, True), (None, None, False), (None, 121.0, False)]
    pts = spark.createDataFrame([(21.5, 119.5), (25.5, 122.5), (10.0, 121.0), (None, 121.0)], "a double, b double")
    assert [r[0] for r in pts.select(geo.valid_geo(pts.a, pts.b)).collect()] == [True, True, False, False]


def test_wide_days(spark):
    cells = {1: ("16:10", "16:15"), 2: ("16:10", "16:15"), 4: ("9:00", "09:05"), 5: ("16:10", ""), 6: ("", "x")}
    row = {f"g_d{i}_time_{s}": cells.get(i, ("", ""))[k] for i in range(1, 8) for k, s in enumerate("se")}
    out = N.wide_days(spark.createDataFrame([row]), "g", "schedule", "notes").select(entries_text("schedule"), "notes").first()
    assert out[0] == "1,2@16:10-16:15|4@09:00-09:05"
    assert out[1] == ["原始g_d5時間格式異常:'16:10'/''", "原始g_d6時間格式異常:''/'x'"]


def test_flag_days(spark):
    row = {f"garbage{d}": v for d, v in zip(N.FLAG_SUFFIXES, ["Y", "", "N", "Y", "", "", ""])}
    df = spark.createDataFrame([{**row, "t": "18:05"}, {**row, "t": None}], ", ".join(f"{c} string" for c in [*row, "t"]))
    got = N.flag_days(df, "garbage", F.col("t"), "s", "notes").select(entries_text("s"), "notes").collect()
    assert [r[0] for r in got] == ["1,4@18:05-", ""]
    assert got[0].notes == ["garbagewednesday 未知格式已捨棄:'N'"]


def timetable(spark, primary, memo, bare):
    df = spark.createDataFrame([(primary, memo, bare)], "p string, m string, b string")
    r = N.text_timetable(df, "p", "m", "b").select(entries_text("entries").alias("e"), "drops", "memo_entries", "mismatch", F.transform("entries", lambda e: e["weekday_source"]).alias("src")).first()
    return r


def test_timetable_lines(spark):
    r = timetable(spark, "星期二,五,六：17:03", "星期一,四：17:04", "17:03")
    assert (r.e, r.drops, r.memo_entries, r.mismatch, r.src) == ("2,5,6@17:03-|1,4@17:04-", [], 1, False, ["listed", "listed"])
    r = timetable(spark, "班表時間：9:30", "", "09:30")
    assert (r.e, r.mismatch, r.src) == ("@9:30-", True, ["absent"])
    assert timetable(spark, "", "", None).e == ""
    # memo alone keeps the point
    assert timetable(spark, "", "星期三：21:05", "21:05").e == "3@21:05-"


def test_damaged_timetable_lines(spark):
    r = timetable(spark, "星期一：18:041", "", "18:041")
    assert r.e == "" and len(r.drops) == 1
    r = timetable(spark, "星期一：18:041", "", "18:04")
    assert r.e == "@18:04-" and "復原" in r.drops[0]
    five = "星期一：18:00\n星期二：18:01\n星期三；18:02\n星期四：18:03\n星期五：18:04"
    r = timetable(spark, five, "", "18:02")
    assert r.e == "1@18:00-|2@18:01-|4@18:03-|5@18:04-" and len(r.drops) == 1
    # the memo never falls back
    assert timetable(spark, "", "壞", "18:00").e == ""


def test_grid_rows(spark):
    both, garbage, none = "16:10~16:15\n(16:10~16:15)", "9:00~9:10\n(無清運)", "無清運"
    week = [both, both, none, garbage, none, none, none]
    rows = [
        (1, ["里", "P1", "路\n1"] + week),
        (2, ["里", "", "路"] + ["沿街"] + week),
        (3, ["里", "P", "路"] + week[:6]),
        (4, ["里", "P", "路"] + week[:6] + ["18:00-19:00"]),
        (5, ["里", "P", " "] + week),
        (6, ["里", "P", "路"] + ["其他"] + week),
        (7, ["里別"] + [""] * 9),
        (8, [" "] + [""] * 9),
    ]
    df = N.grid_rows(spark.createDataFrame(rows, "id int, cells array<string>"))
    rows = {r.id: r for r in df.select("*", entries_text("schedule").alias("s"), entries_text("recycling_schedule").alias("rs")).collect()}
    assert {i: r.drop_reason for i, r in rows.items()} == {1: None, 2: None, 3: "wrong_col_count", 4: "cell_pattern_fail", 5: "empty_point_name", 6: "unknown_collection_type"}
    assert (rows[1].s, rows[1].rs, rows[1].first_arrive, rows[1].point_name) == ("1,2@16:10-16:15|4@9:00-9:10", "1,2@16:10-16:15", "16:10", "路1")
    assert (rows[1].collection_type, rows[2].collection_type, rows[2].plate) == ("定點清運", "沿街收運", None)


def test_ids(spark):
    df = spark.createDataFrame([(x,) for x in ("TYN-LUZHU-AB-C", "TYN-LUZHU", "TYN--1", "TYN-X-1--2", "KHH-X-06852")], "i string")
    assert [tuple(r) for r in df.select(*N.parse_id(df.i)).collect()] == [("luzhu", "AB-C"), (None, None), (None, None), (None, None), ("x", "06852")]


def nested(spark, rows):
    """rows: (id, schedule, recycling, foodscraps), each a list of (days, arrive, depart)."""
    return spark.createDataFrame(rows, f"ord int, schedule {N.ENTRIES}, recycling_schedule {N.ENTRIES}, foodscraps_schedule {N.ENTRIES}")


def test_publishing_forms(spark):
    df = nested(spark, [(1, [], [([1], "08:00", None)], None), (2, None, [], [])])
    got = df.select(N.sanitize(F.col("schedule"), True), N.sanitize(F.col("recycling_schedule"), False), N.sanitize(F.col("foodscraps_schedule"), False)).collect()
    assert got[0][0] == [] and len(got[0][1]) == 1 and got[0][2] is None
    assert tuple(got[1]) == ([], None, None)
    named = df.withColumn("district", F.lit("d")).withColumn("point_name", F.lit("n")).withColumn("r", N.publish_reason(N.has_entries("schedule", "recycling_schedule", "foodscraps_schedule")))
    assert [r.r for r in named.orderBy("ord").collect()] == [None, "empty_schedule_and_recycling"]


def test_quality_layers(spark):
    e = "array<struct<weekday:array<int>,arrive:string,depart:string,weekday_source:string>>"
    rows = [
        ("c", "市", "區", "名", 24.0, 121.0, [([1], "08:00", None, "listed"), ([], "08:00", "x", "absent"), ([], "8:00", None, None)]),
        ("c", "市", "區", "名", 10.0, 121.0, [([9], "08:00", "09:00", "listed"), ([1], "08:00", None, "absent")]),
        ("c", "市", None, "名", None, 121.0, []),
    ]
    p = spark.createDataFrame(rows, f"k string, city string, district string, point_name string, lat double, lng double, schedule {e}")
    one, two = Q.layer1(p, ["k"]).first(), Q.layer2(p, ["k"], ["schedule"]).first()
    assert (one.total, one.complete, one.passed) == (3, 2, False)
    assert (two.time_violations, two.weekday_violations, two.coord_checked, two.coord_violations) == (2, 3, 2, 1)
    assert (two.listed, two.absent, two.unspecified, two.passed) == (2, 2, 1, False)
    counts = spark.createDataFrame([("a", 100), ("b", 100), ("z", 100), ("n", 5)], "k string, total bigint")
    base = spark.createDataFrame([("a", 80), ("b", 50), ("z", 0)], "k string, count bigint")
    three = {r.k: (r.rate, r.passed) for r in Q.layer3(counts, base, "k").collect()}
    assert three == {"a": (0.25, True), "b": (1.0, False), "z": (1.0, False), "n": (None, True)}


def test_gate_raises(spark):
    r = spark.createDataFrame([("a", True), ("b", False)], "k string, passed boolean")
    with pytest.raises(ValueError, match="b"):
        Q.gate(r, "k")
    Q.gate(r.filter("passed"), "k")
    with pytest.raises(ValueError):
        Q.require_empty(r, "rows")


def test_service_times_and_next_run(spark):
    e = spark.createDataFrame([(1, "garbage", d, t, None) for d, t in ((1, "18:47"), (2, "18:47"), (2, "21:01"), (4, "21:01"), (None, "17:00"), (3, "bad"))], "ord int, kind string, weekday int, arrive string, depart string")
    assert {r.weekday: r.times for r in S.weekday_times(e).collect()} == {1: ["18:47"], 2: ["18:47", "21:01"], 4: ["21:01"]}
    asks = [(1, 1, 2, "10:00"), (2, 1, 2, "19:00"), (3, 1, 2, "21:01"), (4, 1, 1, "20:00"), (5, 1, 4, "22:00"), (6, 9, 1, "10:00"), (7, 1, 2, "bad"), (8, 1, 4, "21:30")]
    got = {r.a: (r.offset, r.time, r.label) for r in S.next_run(spark.createDataFrame(asks, "a int, ord int, weekday int, now string"), e, "a").collect()}
    assert got[1] == (0, "18:47", "今天 18:47") and got[2][:2] == (0, "21:01") and got[3][:2] == (0, "21:01")
    assert got[4] == (1, "18:47", "明天 18:47") and got[5] == (4, "18:47", "週一 18:47")
    assert got[6] == (None, None, None) and got[7] == (None, None, None)
    one = spark.createDataFrame([(1, "garbage", 3, "08:00", None)], "ord int, kind string, weekday int, arrive string, depart string")
    same = S.next_run(spark.createDataFrame([(1, 1, 3, "09:00")], "a int, ord int, weekday int, now string"), one, "a").first()
    assert (same.offset, same.key) == (7, 7 * 1440 + 480)


@pytest.mark.parametrize(
    "schedule, recycling, food, kind, shape",
    [
        ([([1], "16:10", "16:15")], [], [], "FIXED", "typed"),
        ([([1], "16:10", None)], [], [], None, "untyped"),
        ([([1], "16:10", "16:10")], [], [], "PASS", "passing"),
        ([([], "16:10", None)], [], [], None, "unknown"),
        ([([1], "16:10", None), ([2], "17:10", None)], [], [], None, "varied"),
        ([], [([], "09:00", None)], [], None, "other_unknown"),
        ([], [([1], "09:00", None)], [], None, "other_fixed"),
        ([], [([1], "09:00", None), ([2], "10:00", None)], [], None, "other_varied"),
        ([], [], [([1], "09:00", None)], None, "other_fixed"),
        ([], [], [], None, "no_times"),
    ],
)
def test_summary_shapes(spark, schedule, recycling, food, kind, shape):
    base = nested(spark, [(1, schedule, recycling, food)])
    p = base.select("*", *[F.lit(v).cast("string").alias(c) for c, v in dict(point_id="T-D-1", district="區", village="里", point_name="路", address="市區路", collection_type=kind).items()])
    r = T.point_summary(p, F.col("collection_type") == "PASS").first()
    assert r["shape"] == shape
    assert "{" not in r.summary and r.summary.endswith("。")
    assert ("廚餘" in r.summary) == bool(food) and ("僅提供資源回收" in r.summary) == bool(recycling)


def test_day_status(spark):
    df = nested(spark, [(1, [([1, 2], "08:00", None), ([], "09:00", None)], [], []), (2, [([], "09:00", None)], [], []), (3, [], [([1], "08:00", None)], []), (4, [], [], [([1], "08:00", None)]), (5, [], [], [])])
    got = {(r["ord"], r.today): r.status for r in S.day_status(df).collect()}
    assert got[1, 1] == "service_today" and got[1, 3] == "other_days" and got[2, 1] == "weekday_unknown"
    assert (got[3, 1], got[4, 1], got[5, 1]) == ("recycling_only", "foodscraps_only", "no_data")
