"""Data-quality checks as tables, and the gate that reads one small report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.geo import valid_geo
from schedlake.functions.times import is_clock
from schedlake.operators.skew import order_range

# Thresholds of the three layers.
L1_MIN_COMPLETE = 0.95
L2_MAX_COORD_RATE = 0.05
L3_MAX_CHANGE = 0.30

#: Rows of key and parent that one task tells apart, on average.
PAIR_ROWS = 1_000_000

#: Entries that still carry the audit tag.
TAGGED = "array<struct<weekday:array<int>,arrive:string,depart:string,weekday_source:string>>"


def rate(part: Column, total: Column, empty: float = 0.0) -> Column:
    return F.when(total == 0, F.lit(empty)).otherwise(part / total)


def _layer1_counts() -> list[Column]:
    text = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("city", "district", "point_name")]
    whole = reduce(lambda a, b: a & b, text) & F.coalesce(F.size("schedule") > 0, F.lit(False))
    return [F.count(F.lit(1)).alias("total"), F.count_if(whole).alias("complete")]


def layer1(points: DataFrame, keys: list[str]) -> DataFrame:
    """Completeness: rows with non-blank city, district and name and a non-empty schedule (an empty array counts as missing)."""
    out = points.groupBy(*keys).agg(*_layer1_counts())
    return out.withColumn("rate", rate(F.col("complete"), F.col("total"))).withColumn("passed", F.col("rate") >= L1_MIN_COMPLETE)


def entry_violations(entries: Column) -> Column:
    """(time, weekday, listed, absent, unspecified) counts of one point's entries; row-local.

    Entries are (weekday, arrive, depart, weekday_source). A bad arrival and a bad non-null departure count separately.
    'absent' entries must have no weekday, all others a non-empty list within 1..7.
    """
    source = lambda e: F.coalesce(e["weekday_source"], F.lit("unspecified"))
    days = lambda e: F.coalesce(e["weekday"], F.array().cast("array<int>"))

    def bad_days(e):
        out_of_range = F.exists(days(e), lambda d: ~d.between(1, 7))
        return F.when(source(e) == "absent", F.size(days(e)) > 0).otherwise((F.size(days(e)) == 0) | out_of_range)

    count = lambda test: F.size(F.filter(entries, test))
    return F.struct(
        (count(lambda e: ~is_clock(e["arrive"])) + count(lambda e: e["depart"].isNotNull() & ~is_clock(e["depart"]))).alias("time"),
        count(bad_days).alias("weekday"),
        count(lambda e: source(e) == "listed").alias("listed"),
        count(lambda e: source(e) == "absent").alias("absent"),
        count(lambda e: source(e) == "unspecified").alias("unspecified"),
    )


def _with_violations(points: DataFrame, arrays: list[str]) -> DataFrame:
    every = F.concat(*[F.coalesce(F.col(a), F.array().cast(TAGGED)) for a in arrays])
    return points.withColumn("v", entry_violations(every))


def _layer2_counts() -> list[Column]:
    checked = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return [
        F.sum("v.time").alias("time_violations"),
        F.sum("v.weekday").alias("weekday_violations"),
        F.sum("v.listed").alias("listed"),
        F.sum("v.absent").alias("absent"),
        F.sum("v.unspecified").alias("unspecified"),
        F.count_if(checked).alias("coord_checked"),
        F.count_if(checked & ~valid_geo(F.col("lat"), F.col("lng"))).alias("coord_violations"),
    ]


def layer2(points: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Reasonableness over all schedules together. Passing depends only on the share of bad coordinates."""
    out = _with_violations(points, arrays).groupBy(*keys).agg(*_layer2_counts())
    return out.withColumn("rate", rate(F.col("coord_violations"), F.col("coord_checked"))).withColumn("passed", F.col("rate") <= L2_MAX_COORD_RATE)


def layer3(counts: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Drift against the previous count. No baseline passes with a note; a baseline of 0 is a change of 1."""
    joined = counts.join(baseline.select(key, F.col("count").alias("previous")), key, "left")
    change = F.when(F.col("previous") == 0, F.lit(1.0)).otherwise(F.abs(F.col("total") - F.col("previous")) / F.col("previous"))
    return (
        joined.withColumn("rate", change)
        .withColumn("note", F.when(F.col("previous").isNull(), "no baseline"))
        .withColumn("passed", F.coalesce(F.col("rate") <= L3_MAX_CHANGE, F.lit(True)))
    )


def report(points: DataFrame, baseline: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """One row per partition with the three layers and the overall verdict, in one pass over the points."""
    counts = _with_violations(points, arrays).groupBy(key).agg(*_layer1_counts(), *_layer2_counts())
    l1, l2 = rate(F.col("complete"), F.col("total")), rate(F.col("coord_violations"), F.col("coord_checked"))
    counts = counts.select(key, "total", l1.alias("l1_rate"), l2.alias("l2_rate"))
    drift = layer3(counts, baseline, key).withColumnRenamed("rate", "l3_rate").withColumnRenamed("passed", "l3_passed").drop("previous", "note")
    out = drift.withColumn("l1_passed", F.col("l1_rate") >= L1_MIN_COMPLETE).withColumn("l2_passed", F.col("l2_rate") <= L2_MAX_COORD_RATE)
    passed = F.col("l1_passed") & F.col("l2_passed") & F.col("l3_passed")
    return out.select(key, "total", "l1_rate", "l1_passed", "l2_rate", "l2_passed", "l3_rate", "l3_passed", passed.alias("passed"))


def gate(report_df: DataFrame, key: str) -> None:
    """Raises when a partition fails; the message names up to 20 of them. Passing ones are the report's own rows."""
    failed = report_df.filter(~F.col("passed")).select(key).limit(20).collect()
    if failed:
        raise ValueError("validation failed for " + ", ".join(str(r[0]) for r in failed))


def weekday_source(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries per weekday source with their share. The total is a window over the few grouped rows."""
    counts = entries.groupBy(*keys, F.coalesce("weekday_source", F.lit("unspecified")).alias("weekday_source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def publish_report(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Total, publishable and filtered rows, with counts by reason."""
    reasons = ["missing_district", "missing_point_name", "empty_schedule_and_recycling"]
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("reason").isNull()).alias("publishable"),
        F.count("reason").alias("filtered"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in reasons],
    )


def drop_report(rows: DataFrame, key: str) -> DataFrame:
    """Valid and dropped rows by reason per partition, with a total row (NULL key)."""
    reasons = ["wrong_col_count", "cell_pattern_fail", "empty_point_name", "unknown_collection_type"]
    return rows.rollup(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("drop_reason").isNull()).alias("valid"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in reasons],
    )


def download_dates(rows: DataFrame, date_col: str) -> DataFrame:
    """Distinct download dates of a batch and whether they disagree."""
    return rows.agg(F.count_distinct(date_col).alias("dates")).withColumn("mixed", F.col("dates") > 1)


def multi_parent(rows: DataFrame, key: str, parent: str, expected: int | None = None) -> DataFrame:
    """Keys served by more than one parent.

    Pairs are dealt into tasks of PAIR_ROWS on average, so a task's hash tables stay as small however many pairs there are.
    ``expected`` is about the number of rows, where the caller knows it; else they are counted, which is cheap on a settled table.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows.count() if expected is None else expected) // PAIR_ROWS))
    pairs = rows.select(key, parent).repartition(parts, key, parent).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("parents")).filter("parents > 1")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def whitelist(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Distinct values of ``column`` that the allowed set lacks, with their number."""
    values = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.join(allowed.select(F.col(allowed.columns[0]).alias("value")).distinct(), "value", "left_anti")


def reference_check(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only: 'missing' on the right, or 'stale' there."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        a.join(b, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("stale")))
    )


def host_names(urls: DataFrame, names: DataFrame) -> DataFrame:
    """Display name per host; ``missing`` marks a host without one."""
    return urls.join(names, "host", "left").withColumn("missing", F.col("name").isNull())


def require_empty(violations: DataFrame, what: str) -> None:
    """Stops the job when a violations table has rows; the message shows up to five of them."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def date_gaps(days: DataFrame, d: str, partition: Column) -> DataFrame:
    """Missing stretches between successive dates, looked up by the date itself instead of a global ordering.

    The next date is looked up inside the partition (a year of at most 366 rows); the last
    date of a partition is followed by the first of the next, found over one row per partition.
    """
    per = days.select(F.col(d).alias("d"), partition.alias("part")).distinct()
    inside = per.withColumn("next", F.lead("d").over(Window.partitionBy("part").orderBy("d")))
    firsts = per.groupBy("part").agg(F.min("d").alias("first")).withColumn("next_first", F.lead("first").over(Window.orderBy("part")))
    return (
        inside.join(firsts.drop("first"), "part")
        .withColumn("next", F.coalesce("next", "next_first"))
        .withColumn("missing_days", F.datediff("next", "d") - 1)
        .filter("missing_days > 0")
        .select(F.col("d").alias("after"), F.col("next").alias("before"), "missing_days")
    )


def unsorted(rows: DataFrame, order: str, d: str) -> DataFrame:
    """Rows whose value is below an earlier one (by the unique numeric ``order``).

    The running maximum is taken inside ranges of ``order`` and over one maximum per range.
    """
    ranged = rows.withColumn("__range", order_range(order))
    tops = ranged.groupBy("__range").agg(F.max(d).alias("__top"))
    earlier = F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max(d).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("__inside", inside).join(tops.withColumn("__earlier", earlier).drop("__top"), "__range")
    return out.filter(F.col(d) < F.greatest("__inside", "__earlier")).drop("__range", "__inside", "__earlier")


def spot_checks(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Expected rows against the table: (keys, expected, positive flag) with ``ok``.

    A positive expectation needs an equal value among the matches, a negative one needs none.
    """
    hits = expected.join(actual.select(*keys, F.col(value).alias("actual")), keys, "left")
    found = F.max(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))
    return hits.groupBy(*keys, "expected", "positive").agg(found.alias("found")).withColumn("ok", F.col("found") == F.col("positive"))


def normalize_stats(stops: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a normalising run over parsed, united stops (see ``plans/quality.py`` for the expected columns)."""
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    listed = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast(TAGGED)), lambda e: e["weekday_source"] == "listed"))
    kept = F.col("district").isNotNull()
    empty = (n("schedule") == 0) & (n("recycling") == 0)
    final = kept & ~empty
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long")
    return stops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("union_total"),
        F.count_if(~kept).alias("dropped_missing_district"),
        F.count_if(kept & empty).alias("dropped_empty_both"),
        F.count_if(kept & (n("schedule") == 0) & (n("recycling") > 0)).alias("recycle_only_points"),
        total(kept, n("schedule_drops")).alias("schedule_line_drops"),
        total(kept, n("recycling_drops")).alias("recycling_line_drops"),
        total(kept, F.coalesce("schedule_memo", F.lit(0))).alias("schedule_memo_added"),
        total(kept, F.coalesce("recycling_memo", F.lit(0))).alias("recycling_memo_added"),
        total(kept, listed("schedule")).alias("schedule_listed"),
        total(kept, n("schedule") - listed("schedule")).alias("schedule_absent"),
        total(kept, listed("recycling")).alias("recycling_listed"),
        total(kept, n("recycling") - listed("recycling")).alias("recycling_absent"),
        F.count_if(kept & (n("recycling") > 0)).alias("has_recycling"),
        total(kept, F.coalesce("mismatches", F.lit(0))).alias("arrive_mismatch"),
        F.count_if(final).alias("final_count"),
    )
