"""District statistics on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from schedlake.operators import content as T
from schedlake.operators import maintained as M
from schedlake.operators import stats as S
from schedlake.session import cut_lineage

POINT = "ord int, city_slug string, district_slug string, village string"
ENTRY = "ord int, kind string, weekday int, arrive string, depart string"


def points(spark, villages):
    return spark.createDataFrame([(i, "c", "d", v) for i, v in enumerate(villages, 1)], POINT)


def entries(spark, rows):
    """rows: (point, kind, weekdays, arrive); an empty list is an unknown day."""
    flat = [(p, k, d, a, None) for p, k, days, a in rows for d in (days or [None])]
    return spark.createDataFrame(flat, ENTRY)


def stats(spark, villages, rows):
    return S.district_stats(points(spark, villages), entries(spark, rows)).first()


def test_uniform_district(spark):
    week = [1, 2, 4, 5, 6]
    times = {1: "16:10", 2: "17:00", 3: "19:40"}
    rows = [(p, k, week, t) for p, t in times.items() for k in ("garbage", "recycling")]
    r = stats(spark, ["甲里", "甲里", "乙里"], rows)
    assert (r.point_count, r.village_count) == (3, 2)
    assert r.weekday_counts == [3, 3, 0, 3, 3, 3, 0]
    assert (r.weekday_unknown_points, r.no_schedule_points) == (0, 0)
    assert (r.earliest_arrive, r.latest_arrive) == ("16:10", "19:40")
    assert (r.recycling_points, r.recycling_pct, r.foodscraps_points, r.foodscraps_pct) == (3, 100, 0, 0)


def test_hours_count_entries_not_days(spark):
    # one entry row per merged entry: the histogram counts rows
    rows = spark.createDataFrame([(1, "garbage", None, h, None) for h in ("16:10", "17:00", "19:40")], ENTRY)
    r = S.district_stats(points(spark, ["a"]), rows).first()
    assert [h for h, n in enumerate(r.hour_counts) if n] == [16, 17, 19]


def test_unknown_days_and_recycling_only(spark):
    r = stats(spark, ["v"] * 4, [(1, "garbage", [1, 4], "08:00"), (2, "garbage", [], "09:00"), (3, "garbage", [], "09:30"), (4, "recycling", [2], "10:00")])
    assert (r.weekday_unknown_points, r.no_schedule_points) == (2, 1)
    assert r.weekday_counts == [1, 0, 0, 1, 0, 0, 0]
    assert (r.earliest_arrive, r.latest_arrive) == ("08:00", "09:30")
    assert (r.recycling_points, r.recycling_pct) == (1, 25)


def test_no_schedule_at_all(spark):
    r = stats(spark, ["v"], [(1, "recycling", [1], "09:00")])
    assert (r.earliest_arrive, r.latest_arrive, r.no_schedule_points) == (None, None, 1)


def test_coverage_rounds(spark):
    r = stats(spark, ["v"] * 3, [(1, "garbage", [1], "09:00"), (1, "recycling", [1], "09:00"), (2, "garbage", [1], "09:00"), (3, "garbage", [1], "09:00")])
    assert r.recycling_pct == 33


def test_villages_skip_blank_and_sort_by_locale(spark):
    got = S.village_groups(points(spark, ["三民里", "一心里", None, "三民里", "乙里", ""])).collect()
    assert [(r.village, r.points) for r in got] == [("一心里", 1), ("乙里", 1), ("三民里", 2)]


def test_date_range_of_mixed_formats(spark):
    df = spark.createDataFrame([("x", "2026-07-23"), ("x", "2026-07-28T11:50:16.537798+08:00")], "city_slug string, fetched_at string")
    assert tuple(S.date_range(df, ["city_slug"]).first())[1:] == ("2026-07-23", "2026-07-28")


def sentence(spark, counts):
    df = spark.createDataFrame([("c", "d", counts)], "city_slug string, district_slug string, weekday_counts array<bigint>")
    return T.weekday_sentence(df).first()


def test_weekday_sentences(spark):
    r = sentence(spark, [1641, 1642, 31, 1641, 1642, 1641, 17])
    assert r.normal_days == [1, 2, 4, 5, 6] and r.low_days == [3, 7]
    assert r.weekday_text == "週一、週二、週四、週五、週六約 1641–1642 個點有班次;週三僅 31 個點、週日僅 17 個點。"
    r = sentence(spark, [10, 10, 2, 10, 10, 0, 10])
    assert r.weekday_text == "週一、週二、週四、週五、週日 10 個點有班次;週三僅 2 個點;週六目前沒有登記的收運班次。"
    assert sentence(spark, [0] * 7).weekday_text is None


def test_peak_hours(spark):
    def peak(bins):
        df = spark.createDataFrame([("c", "d", h, n) for h, n in bins.items()], "city_slug string, district_slug string, hour int, entries bigint")
        r = S.peak_hours(df).first()
        return r.hours, r.peak

    assert peak({18: 9, 19: 6, 20: 1}) == ([18], 9)
    assert peak({h: 1 for h in range(5)}) == (None, None)
    assert peak({h: 4 for h in range(4)}) == (None, None)


def test_children_and_siblings_of_a_huge_parent(spark):
    df = spark.createDataFrame([("p", f"c{i:05d}") for i in range(10_001)] + [("q", "x")], "p string, c string")
    lists = {r.p: r.children for r in S.children(df, "p", "c").collect()}
    assert len(lists["p"]) == 10_001 and lists["q"] == ["x"]
    asked = spark.createDataFrame([("p", "c00007"), ("q", "x")], "p string, c string")
    got = [r.sibling for r in S.siblings(asked, df, "p", "c").collect()]
    assert len(got) == 10_000 and "c00007" not in got


def test_statistics_kept_by_changes(spark):
    """Random replacements, earliest and latest arrivals and whole districts included, against a rescan after each."""
    rnd = random.Random(6)
    point = "ord bigint, city_slug string, district_slug string, village string"
    entry = "ord bigint, kind string, weekday int, arrive string, depart string"

    def draw(i):
        place = (i, "c", f"d{rnd.randrange(4)}", rnd.choice([None, "", "v1", "v2", "v3"]))
        kinds = rnd.choice([[], ["garbage"], ["garbage", "garbage", "recycling"], ["foodscraps"]])
        return place, [(i, k, rnd.choice([None, *range(1, 8)]), f"{rnd.randrange(24):02d}:{rnd.randrange(60):02d}", None) for k in kinds]

    frames = lambda rows: (spark.createDataFrame([p for p, _ in rows], point), spark.createDataFrame([e for _, es in rows for e in es], entry))
    key = lambda r: (r.city_slug, r.district_slug)
    held = {i: draw(i) for i in range(60)}
    state = cut_lineage(M.measures(*frames(held.values())))
    for turn in range(3):
        gone = [i for i in held if held[i][0][2] == "d3" or rnd.random() < 0.3] if turn == 1 else rnd.sample(sorted(held), 15)
        old = [held.pop(i) for i in gone]
        new = {1000 * (turn + 1) + k: draw(1000 * (turn + 1) + k) for k in range(12)}
        held |= new
        state = cut_lineage(M.changed(state, M.measures(*frames(new.values())), M.measures(*frames(old))))
        want = S.district_stats(*frames(held.values()))
        got = M.statistics(state).select(want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(Exception, match="more points removed"):
        M.changed(state, None, M.measures(*frames(held.values())).withColumn("n", F.col("n") + 1)).collect()
