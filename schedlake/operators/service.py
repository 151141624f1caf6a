"""Weekly service questions: weekday times, next run, day status, holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.dates import iso_weekday
from schedlake.functions.times import CLOCK_SHAPE, minutes, weekday_name

def weekday_times(entries: DataFrame, id_col: str = "ord") -> DataFrame:
    """Sorted distinct garbage arrivals per point and weekday; unknown days and malformed times are left out."""
    rows = entries.filter((F.col("kind") == "garbage") & F.col("weekday").isNotNull() & F.col("arrive").rlike(CLOCK_SHAPE))
    return rows.groupBy(id_col, "weekday").agg(F.sort_array(F.collect_set("arrive")).alias("times"))


def weekly_times(entries: DataFrame, id_col: str = "ord") -> DataFrame:
    """All (weekday, time) of a point in one sorted array: at most 7 x 1440 values whatever the number of entries."""
    rows = entries.filter((F.col("kind") == "garbage") & F.col("weekday").isNotNull() & F.col("arrive").rlike(CLOCK_SHAPE))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("weekday", "arrive"))).alias("week"))


def next_run(asks: DataFrame, entries: DataFrame, ask_id: str, id_col: str = "ord") -> DataFrame:
    """Next arrival for (point, weekday, now): offset 0 today if not past, up to 7 for the same day next week.

    The weekly array is small and joined once per ask; the search itself is row-local. Sorted by key, unknown last.
    """
    joined = asks.join(weekly_times(entries, id_col), [id_col], "left")

    def ahead(x: Column) -> Column:
        days = F.pmod(x["weekday"] - F.col("weekday"), F.lit(7))
        offset = F.when((days == 0) & (x["arrive"] < F.col("now")), 7).otherwise(days)
        return F.struct((offset * 1440 + minutes(x["arrive"])).alias("key"), offset.alias("offset"), x["arrive"].alias("time"), x["weekday"].alias("day"))

    best = F.array_min(F.transform("week", ahead))
    out = joined.withColumn("best", F.when(F.col("now").rlike(CLOCK_SHAPE), best)).drop("week")
    label = F.when(F.col("best.offset") == 0, "今天").when(F.col("best.offset") == 1, "明天").otherwise(weekday_name(F.col("best.day")))
    return out.select(
        *asks.columns,
        F.col("best.key").alias("key"),
        F.col("best.offset").alias("offset"),
        F.col("best.time").alias("time"),
        F.concat(label, F.lit(" "), F.col("best.time")).alias("label"),
    )


def day_status(points: DataFrame) -> DataFrame:
    """Status of every point on every weekday, from its nested schedules; the seven days are exploded row-locally.

    The first entry that serves the day decides; without one: other days, unknown days, or what else the point offers.
    """
    days = F.transform("schedule", lambda e: e["weekday"])
    known = F.sort_array(F.array_distinct(F.flatten(days)))
    unknown = F.array_distinct(F.transform(F.filter("schedule", lambda e: F.size(e["weekday"]) == 0), lambda e: e["arrive"]))
    base = (
        points.withColumn("known_days", known)
        .withColumn("unknown_times", F.array_join(unknown, "、"))
        .withColumn("has_unknown", F.exists("schedule", lambda e: F.size(e["weekday"]) == 0))
        .withColumn("today", F.explode(F.sequence(F.lit(1), F.lit(7))))
    )
    hit = F.get(F.filter("schedule", lambda e: F.array_contains(e["weekday"], F.col("today"))), F.lit(0))
    status = (
        F.when(F.size("schedule") == 0, F.when(F.size("recycling_schedule") > 0, "recycling_only").when(F.size("foodscraps_schedule") > 0, "foodscraps_only").otherwise("no_data"))
        .when(F.col("hit").isNotNull(), "service_today")
        .when(F.size("known_days") > 0, "other_days")
        .otherwise("weekday_unknown")
    )
    return base.withColumn("hit", hit).withColumn("status", status)


def holiday_service(visits: DataFrame, masks: DataFrame, holidays: DataFrame, visit_id: str, id_col: str = "ord") -> DataFrame:
    """Visits (point, date) with the first line to show: on a named holiday a served day gets the notice instead.

    ``masks`` has one row per point, ``holidays`` one per date.
    """
    joined = visits.join(masks, [id_col], "left").join(holidays.select("d", F.lit(True).alias("holiday")).distinct(), "d", "left")
    served = F.call_function("shiftright", F.coalesce("mask", F.lit(0)), iso_weekday(F.col("d")) - 1) % 2 == 1
    notice = F.when(served & F.col("holiday").isNotNull(), "holiday_notice").when(served, "service").otherwise("no_service")
    return joined.select(*visits.columns, served.alias("served"), notice.alias("line"))
