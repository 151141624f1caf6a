"""District and city statistics over points and long-form entries.

Entries are first reduced to one row per point (bit mask of weekdays, minimum, maximum,
counts), a partial aggregation that also disarms a point holding many entries. Only then
are they joined to the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.times import mask_days, weekday_bit
from schedlake.operators.normalize import parse_id

DISTRICT = ["city_slug", "district_slug"]


def percent(part: Column, total: Column) -> Column:
    """Rounded percentage, 0 for an empty total."""
    return F.when(total == 0, F.lit(0)).otherwise(F.round(100 * part / total)).cast("int")


def hour_of(arrive: Column) -> Column:
    hour = F.substring(arrive, 1, 2).try_cast("int")
    return F.when(hour.between(0, 23), hour)


def point_profile(entries: DataFrame, id_col: str, hours: bool = False) -> DataFrame:
    """One row per point: number of garbage entries, weekday mask, first and last arrival, other services."""
    garbage = F.col("kind") == "garbage"
    aggs = [
        F.count_if(garbage).alias("n_garbage"),
        F.bit_or(F.when(garbage, weekday_bit(F.col("weekday"))).otherwise(F.lit(0))).alias("mask"),
        F.min(F.when(garbage, F.col("arrive"))).alias("first"),
        F.max(F.when(garbage, F.col("arrive"))).alias("last"),
        F.max(F.col("kind") == "recycling").alias("recycling"),
        F.max(F.col("kind") == "foodscraps").alias("foodscraps"),
    ]
    if hours:
        hour = hour_of(F.col("arrive"))
        aggs += [F.count_if(garbage & (hour == h)).alias(f"h{h}") for h in range(24)]
    return entries.groupBy(id_col).agg(*aggs)


def district_stats(points: DataFrame, entries: DataFrame, keys: list[str] = DISTRICT, id_col: str = "ord") -> DataFrame:
    """Points, villages, points per weekday, unknown and missing schedules, time range, hour histogram and coverage."""
    joined = points.join(point_profile(entries, id_col, hours=True), id_col, "left")
    n = F.coalesce(F.col("n_garbage"), F.lit(0))
    total = F.col("point_count")
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.count_distinct(F.nullif("village", F.lit(""))).alias("village_count"),
        *[F.count_if(F.call_function("shiftright", "mask", F.lit(w - 1)) % 2 == 1).alias(f"wd{w}") for w in range(1, 8)],
        F.count_if((n > 0) & (F.col("mask") == 0)).alias("weekday_unknown_points"),
        F.count_if(n == 0).alias("no_schedule_points"),
        F.min("first").alias("earliest_arrive"),
        F.max("last").alias("latest_arrive"),
        *[F.coalesce(F.sum(f"h{h}"), F.lit(0)).alias(f"h{h}") for h in range(24)],
        F.count_if("recycling").alias("recycling_points"),
        F.count_if("foodscraps").alias("foodscraps_points"),
    )
    return (
        out.withColumn("weekday_counts", F.array(*[F.col(f"wd{w}") for w in range(1, 8)]))
        .withColumn("hour_counts", F.array(*[F.col(f"h{h}") for h in range(24)]))
        .withColumn("recycling_pct", percent(F.col("recycling_points"), total))
        .withColumn("foodscraps_pct", percent(F.col("foodscraps_points"), total))
        .drop(*[f"wd{w}" for w in range(1, 8)], *[f"h{h}" for h in range(24)])
    )


def weekday_counts(points: DataFrame, entries: DataFrame, keys: list[str] = DISTRICT, id_col: str = "ord") -> DataFrame:
    """Distinct points with garbage service per weekday."""
    masks = entries.filter("kind = 'garbage'").groupBy(id_col).agg(F.bit_or(weekday_bit(F.col("weekday"))).alias("mask"))
    days = points.select(id_col, *keys).join(masks, id_col).select(*keys, F.explode(mask_days(F.col("mask"))).alias("weekday"))
    return days.groupBy(*keys, "weekday").agg(F.count(F.lit(1)).alias("points"))


def hour_histogram(points: DataFrame, entries: DataFrame, keys: list[str] = DISTRICT, id_col: str = "ord") -> DataFrame:
    """Garbage entries per arrival hour."""
    per_point = (
        entries.filter("kind = 'garbage'")
        .groupBy(id_col, hour_of(F.col("arrive")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("hour is not null")
    )
    return points.select(id_col, *keys).join(per_point, id_col).groupBy(*keys, "hour").agg(F.sum("n").alias("entries"))


def peak_hours(histogram: DataFrame, keys: list[str] = DISTRICT, max_ties: int = 3) -> DataFrame:
    """Busiest hours with all ties; none when the maximum is 1 or more than ``max_ties`` hours share it. At most 24 rows per key."""
    bins = histogram.groupBy(*keys).agg(F.max("entries").alias("peak"), F.collect_list(F.struct("hour", "entries")).alias("bins"))
    top = F.sort_array(F.transform(F.filter("bins", lambda b: b["entries"] == F.col("peak")), lambda b: b["hour"]))
    clear = (F.col("peak") > 1) & (F.size("hours") <= max_ties)
    return bins.withColumn("hours", top).select(*keys, F.when(clear, F.col("hours")).alias("hours"), F.when(clear, F.col("peak")).alias("peak"))


def weekday_summary(stats: DataFrame, keys: list[str] = DISTRICT) -> DataFrame:
    """Normal, reduced (below half of the maximum) and zero weekdays of ``weekday_counts`` arrays."""
    counts = F.col("weekday_counts")
    top = F.array_max(counts)
    days = F.sequence(F.lit(1), F.lit(7))
    count = lambda d: F.get(counts, d - 1)
    normal = F.filter(days, lambda d: 2 * count(d) >= top)
    return (
        stats.withColumn("normal_days", F.when(top > 0, normal))
        .withColumn("low_days", F.when(top > 0, F.filter(days, lambda d: (2 * count(d) < top) & (count(d) > 0))))
        .withColumn("zero_days", F.when(top > 0, F.filter(days, lambda d: (2 * count(d) < top) & (count(d) == 0))))
        .withColumn("normal_min", F.array_min(F.transform("normal_days", count)))
        .withColumn("normal_max", F.array_max(F.transform("normal_days", count)))
    )


def district_groups(points: DataFrame, order: str = "ord") -> DataFrame:
    """Districts by the slug inside the point id; the name is the first row's. Malformed ids are skipped."""
    slug, _ = parse_id(F.col("point_id"))
    return (
        points.withColumn("slug", slug)
        .filter("slug is not null")
        .groupBy("city_slug", "slug")
        .agg(F.min_by("district", order).alias("district"), F.count(F.lit(1)).alias("points"))
    )


def village_groups(points: DataFrame, keys: list[str] = DISTRICT, locale: str = "zh_Hant") -> DataFrame:
    """Points per non-blank village, in locale order."""
    return (
        points.filter(F.coalesce(F.col("village") != "", F.lit(False)))
        .groupBy(*keys, "village")
        .agg(F.count(F.lit(1)).alias("points"))
        .orderBy(*keys, F.collate(F.col("village"), locale))
    )


def date_range(points: DataFrame, keys: list[str]) -> DataFrame:
    """First and last date of mixed-format timestamps, by their first ten characters."""
    day = F.substring("fetched_at", 1, 10)
    return points.groupBy(*keys).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def city_stats(points: DataFrame, total_cities: int) -> DataFrame:
    """Districts and points per city, and how many cities are still missing."""
    present = points.agg(F.count_distinct("city_slug")).scalar()
    return (
        points.groupBy("city_slug")
        .agg(F.count_distinct("district_slug").alias("districts"), F.count(F.lit(1)).alias("points"))
        .withColumn("remaining_cities", F.lit(total_cities) - present)
    )


def time_table(points: DataFrame, entries: DataFrame, keys: list[str] = DISTRICT, id_col: str = "ord") -> DataFrame:
    """Points with their first garbage arrival, '99:99' where there is none, sorted by district, time and input order."""
    first = entries.filter("kind = 'garbage'").groupBy(id_col).agg(F.min("arrive").alias("first_arrive"))
    joined = points.select(id_col, *keys, "point_name").join(first, id_col, "left")
    return joined.withColumn("first_arrive", F.coalesce("first_arrive", F.lit("99:99"))).orderBy(*keys, "first_arrive", id_col)


def children(dims: DataFrame, parent: str, child: str) -> DataFrame:
    """One row per parent with its distinct children, sorted: as large as the dimension itself."""
    return dims.select(parent, child).distinct().groupBy(parent).agg(F.sort_array(F.collect_list(child)).alias("children"))


def siblings(asked: DataFrame, dims: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child, sibling) for the asked (parent, child) rows only, by a join on the parent."""
    others = dims.select(parent, F.col(child).alias("sibling")).distinct()
    return asked.select(parent, child).distinct().join(others, parent).filter(F.col("sibling") != F.col(child))
