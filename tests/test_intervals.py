"""Dyadic interval lookups and two-pass scans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from schedlake.operators import intervals as I


def spans(seed, n, width):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a = r.randint(-width, width)
        rows.append((i, a, a + r.choice([0, 0, 1, 2, 7, 100, width, 3 * width]) * r.randint(0, 1) + r.randint(-2, 5)))
    return rows + [(n, None, 5), (n + 1, 5, None), (n + 2, -(2**51), 2**51), (n + 3, 7, 7), (n + 3, 7, 7)]


def test_blocks_cover_each_interval_once(spark):
    rows = spans(1, 300, 40)
    got = I.dyadic_blocks(spark.createDataFrame(rows, "id int, a long, b long"), "a", "b").collect()
    per_level, covered = {}, {}
    for r in got:
        per_level.setdefault((r.id, r.a, r.b, r.block_level), []).append(r.block)
        if r.id < 300:
            covered.setdefault((r.id, r.a, r.b), []).extend(range(r.block << r.block_level, (r.block + 1) << r.block_level))
    assert max(map(len, per_level.values())) <= 2 + 2  # a repeated row doubles its blocks
    assert {k: sorted(v) for k, v in covered.items()} == {r: list(range(r[1], r[2] + 1)) for r in rows[:300] if r[1] <= r[2]}
    assert not any(r.id in (300, 301) for r in got)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_containing_against_all_pairs(spark, how):
    r = random.Random(4)
    iv = [(i, i % 3, a, b) for i, a, b in spans(2, 200, 1000)]
    pts = [(i, i % 4, r.randint(-1500, 4000)) for i in range(300)] + [(300, 1, None), (301, None, 7), (302, 0, 7), (302, 0, 7)]
    points = spark.createDataFrame(pts, "p long, k int, at long").repartition(3)
    ivs = spark.createDataFrame(iv, "i long, k int, a long, b long")
    inside = lambda at, a, b: None not in (at, a, b) and a <= at <= b
    want = []
    for p, k, at in pts:
        hits = [i for i, kk, a, b in iv if kk == k and inside(at, a, b)]
        want += [(p, i) for i in hits] or ([(p, None)] if how == "left" else [])
    got = I.containing(points, "at", ivs, "a", "b", scope=["k"], how=how)
    order = lambda x: (x[0], x[1] is None, x[1] or 0)
    assert sorted(((x.p, x.i) for x in got.collect()), key=order) == sorted(want, key=order)
    none = I.containing(points, "at", ivs.filter("false"), "a", "b", scope=["k"], how=how)
    assert none.count() == (len(pts) if how == "left" else 0)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("few", [0, 10_000])
def test_totals_against_all_pairs(spark, monkeypatch, how, few):
    """Totals of the containing intervals, whether blocks are sent to all executors or shuffled; repeated and null keys included."""
    monkeypatch.setattr(I, "FEW_BLOCKS", few)
    r = random.Random(8)
    iv = [(i, None if i % 50 == 9 else i % 3, a, b) for i, a, b in spans(7, 200, 1000)] + [(None, 1, -50, 50)]
    pts = [(i, i % 4, r.randint(-1500, 4000)) for i in range(300)] + [(300, 1, None), (301, None, 7), (302, 0, 7), (302, 0, 7), (None, 1, 7)]
    points = spark.createDataFrame(pts, "p long, k int, at long").repartition(3)
    ivs = spark.createDataFrame(iv, "i long, k int, a long, b long")
    want = []
    for p, k, at in pts:
        hits = [x for x in iv if None not in (x[1], x[2], x[3], k, at) and x[1] == k and x[2] <= at <= x[3]]
        if hits or how == "left":
            ids = [x[0] for x in hits if x[0] is not None]
            want.append((p, k, at, len(ids), min(ids, default=None), max((x[3] - x[2] for x in hits), default=None)))
    totals = {"n": ("count", F.col("i")), "low": ("min", F.col("i")), "longest": ("max", F.col("b") - F.col("a"))}
    got = I.containing(points, "at", ivs, "a", "b", scope=["k"], how=how, totals=totals)
    assert got.columns == ["p", "k", "at", "n", "low", "longest"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = I.containing(points, "at", ivs.filter("false"), "a", "b", scope=["k"], how=how, totals=totals)
    assert [x.n for x in none.collect()] == [0] * (len(pts) if how == "left" else 0)


def test_totals_make_no_pairs(spark, monkeypatch):
    """3,000 points inside each of 3,000 intervals: nine million pairs, but no table or join holds more rows than points times lengths."""
    import schedlake.plans.sequences  # noqa: F401
    from schedlake.plans.registry import QUERIES

    settled = []
    monkeypatch.setattr(I, "cut_lineage", lambda df, f=I.cut_lineage: settled.append(f(df)) or settled[-1])
    events = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"),
                                      F.expr("timestamp_micros(1000000 * (id div 100))").alias("ts"))
    monkeypatch.setattr(schedlake.plans.sequences, "events", lambda v: events.select("event_id", "user_id", F.col("event_id").alias("at"), F.lit(4000).cast("long").alias("until")))
    rows = QUERIES["interval_containment"](spark, "").collect()
    assert {r.event_id: (r.n, r.first_interval, r.longest) for r in rows} == {i: (i + 1, 0, 4000) for i in range(3000)}
    assert all(t.count() <= 2 * 3000 for t in settled)


def test_no_points_are_sent_through_the_driver(spark, monkeypatch):
    """Spark takes points for as small as before they became a row per block length; neither side is broadcast when blocks are many."""
    monkeypatch.setattr(I, "FEW_BLOCKS", 100)
    rows = spark.range(400).select("id", (F.col("id") * 3).alias("a"), (F.col("id") * 3 + F.col("id") % 90).alias("b"))
    met = I.containing(rows.select(F.col("id").alias("p"), F.col("a").alias("at")), "at", rows, "a", "b")
    assert met.count() == sum(a * 3 <= p * 3 <= a * 3 + a % 90 for a in range(400) for p in range(400))
    text = met._jdf.queryExecution().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_lookups_do_not_grow_with_the_length(spark):
    """Intervals of a minute and of a century: a point is looked up once per block length in use."""
    iv = spark.createDataFrame([(1, 0, 60 * 10**6), (2, 0, 100 * 365 * 86400 * 10**6)], "i long, a long, b long")
    assert I.dyadic_blocks(iv, "a", "b").count() <= 2 * (26 + 52)


def sequence(seed, n):
    r = random.Random(seed)
    return [(i, r.randint(0, n // 2), r.choice([None, r.randint(0, 10**6)]), r.randint(0, 6)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_scans(spark, monkeypatch, n):
    monkeypatch.setattr(I, "RANGE_ROWS", 23)
    rows = sequence(n, n)
    df = spark.createDataFrame(rows, "id int, t long, v int, w long").repartition(5)
    ordered = sorted(rows, key=lambda x: (x[1], x[0]))
    last, high, reach, island = None, None, None, 0
    want = {}
    for i, t, v, w in ordered:
        last = v if v is not None and v % 5 == 0 else last
        high = max(x for x in (high, v) if x is not None) if (high, v) != (None, None) else None
        if reach is None or t > reach + 1:
            island += 1
        reach = max(t + w, reach if reach is not None else t + w)
        want[i] = (last, high, island)
    a = I.last_value(df, ["t", "id"], {"last": F.when(F.col("v") % 5 == 0, F.col("v"))})
    b = I.running_max(a, ["t", "id"], "v", "high")
    c = I.islands(b.withColumn("e", F.col("t") + F.col("w")), ["t", "id"], "t", "e", 1)
    assert {r.id: (r["last"], r.high, r.island) for r in c.collect()} == want


def test_scans_have_no_single_task_window(spark, monkeypatch):
    """The windows without a partition run over one row per range."""
    monkeypatch.setattr(I, "RANGE_ROWS", 50)
    df = spark.range(1000).select(F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    ranged = I._ranged(df, ["t"])
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200
    bounds = ranged.groupBy("__range").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("__range").collect()
    assert all(x.b < y.a for x, y in zip(bounds, bounds[1:]))
