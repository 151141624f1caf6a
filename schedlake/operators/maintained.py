"""District statistics kept up to date by signed changes instead of rescans.

The state is a counted multiset: per district and measure, how many points have each value. Points enter with count 1 and leave with
count -1, so sums follow by addition, and a minimum, a maximum or a number of distinct values is read off the values whose count is not
zero: taking away the earliest arrival reveals the next one. Changes to a few points of a large district move a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.operators.stats import DISTRICT, percent, point_profile

#: Measures of a point that are summed up; the others are kept as counted values.
SUMS = ["points", *[f"wd{w}" for w in range(1, 8)], "unknown", "none", "recycling", "foodscraps", *[f"h{h}" for h in range(24)]]


def measures(points: DataFrame, entries: DataFrame, keys: list[str] = DISTRICT, id_col: str = "ord") -> DataFrame:
    """(keys, measure, value, n): what the points contribute. Sums carry no value; village, first and last arrival carry theirs."""
    joined = points.join(point_profile(entries, id_col, hours=True), id_col, "left")
    garbage = F.coalesce("n_garbage", F.lit(0))
    has = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    amounts: dict[str, Column] = {"points": F.lit(1), "unknown": has((garbage > 0) & (F.col("mask") == 0)), "none": has(garbage == 0)}
    amounts |= {f"wd{w}": has(F.call_function("shiftright", "mask", F.lit(w - 1)) % 2 == 1) for w in range(1, 8)}
    amounts |= {"recycling": has(F.col("recycling")), "foodscraps": has(F.col("foodscraps"))} | {f"h{h}": F.coalesce(f"h{h}", F.lit(0)) for h in range(24)}
    # sums are one row per district and map task before they are told apart
    summed = joined.groupBy(*keys).agg(*[F.sum(amounts[m]).cast("long").alias(m) for m in SUMS])
    text = F.lit(None).cast("string").alias("value")
    told = summed.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, SUMS)), F.array(*SUMS))).alias("measure", "n")).select(*keys, "measure", text, "n")
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("value")) for m, c in (("village", "village"), ("first", "first"), ("last", "last"))])
    valued = joined.select(*keys, F.inline(values)).filter("value IS NOT NULL AND (measure <> 'village' OR value <> '')")
    counted = valued.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    return told.unionByName(counted).filter("n <> 0")


def changed(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, keys: list[str] = DISTRICT) -> DataFrame:
    """The state after points are added and removed; all three as ``measures`` gives them. Raises where more is removed than there is."""
    parts = state
    if added is not None:
        parts = parts.unionByName(added)
    if removed is not None:
        parts = parts.unionByName(removed.withColumn("n", -F.col("n")))
    total = parts.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
    return total.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error("more points removed than were there").cast("long")))


def statistics(state: DataFrame, keys: list[str] = DISTRICT) -> DataFrame:
    """District statistics, with the columns of ``stats.district_stats``, from the state alone."""
    amount = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0))
    value = lambda m: F.when(F.col("measure") == m, F.col("value"))
    out = state.groupBy(*keys).agg(
        amount("points").alias("point_count"),
        F.count_if(F.col("measure") == "village").alias("village_count"),  # one row per village that is left
        amount("unknown").alias("weekday_unknown_points"),
        amount("none").alias("no_schedule_points"),
        F.min(value("first")).alias("earliest_arrive"),
        F.max(value("last")).alias("latest_arrive"),
        amount("recycling").alias("recycling_points"),
        amount("foodscraps").alias("foodscraps_points"),
        F.array(*[amount(f"wd{w}") for w in range(1, 8)]).alias("weekday_counts"),
        F.array(*[amount(f"h{h}") for h in range(24)]).alias("hour_counts"),
    )
    total = F.col("point_count")
    return out.withColumn("recycling_pct", percent(F.col("recycling_points"), total)).withColumn("foodscraps_pct", percent(F.col("foodscraps_points"), total))
