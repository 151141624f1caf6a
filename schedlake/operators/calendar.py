"""Holiday analytics over a daily calendar (d, weekday, is_holiday, memo).

Windows run inside one year, 366 rows at most. Dates are looked up by equality on exploded
intervals, so the large side of an as-of question is never sorted or range-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Holiday names that may title a long weekend, a short label and the in-lieu mark.
HEADLINES = [
    "開國紀念日", "春節", "和平紀念日", "兒童節", "清明節", "勞動節", "端午節", "中秋節",
    "孔子誕辰紀念日/教師節", "國慶日", "臺灣光復暨金門古寧頭大捷紀念日", "行憲紀念日",
]
SHORT_LABELS = {"孔子誕辰紀念日/教師節": "教師節"}
IN_LIEU = "補假"
SOLO_FESTIVALS = ["端午節", "中秋節", "孔子誕辰紀念日/教師節"]


def _year(df: DataFrame, partition: Column | None) -> DataFrame:
    return df.withColumn("year", F.year("d") if partition is None else partition)


def _named(*conditions: Column) -> Column:
    """Memos of a run in date order; at most one per day of the run."""
    keep = F.coalesce(F.col("memo"), F.lit("")) != ""
    for c in conditions:
        keep = keep & c
    return F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("d", "memo")))), lambda x: x["memo"])


def long_weekends(days: DataFrame, min_len: int = 3, partition: Column | None = None) -> DataFrame:
    """Runs of at least ``min_len`` holidays on consecutive dates; a run never leaves its year."""
    w = Window.partitionBy("year").orderBy("d")
    runs = _year(days.filter("is_holiday"), partition).withColumn("run", F.date_sub("d", F.row_number().over(w)))
    return (
        runs.groupBy("year", "run")
        .agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count(F.lit(1)).cast("int").alias("days"), _named().alias("names"))
        .filter(F.col("days") >= min_len)
        .drop("run")
    )


def short_label(name: Column, labels: dict[str, str] = SHORT_LABELS) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in labels.items()], name)


def headline(names: Column, headlines: list[str] = HEADLINES, labels: dict[str, str] = SHORT_LABELS) -> Column:
    """Titling names in order of appearance, shortened, each once."""
    return F.array_distinct(F.transform(F.filter(names, lambda n: n.isin(headlines)), lambda n: short_label(n, labels)))


def titled(weekends: DataFrame, headlines: list[str] = HEADLINES, labels: dict[str, str] = SHORT_LABELS) -> DataFrame:
    """Adds title and slug (MMdd of the start)."""
    plain = F.concat(F.lit("連假("), F.col("start").cast("string"), F.lit(" 起 "), F.col("days").cast("string"), F.lit(" 天)"))
    return (
        weekends.withColumn("__heads", headline(F.col("names"), headlines, labels))
        .withColumn("title", F.when(F.size("__heads") > 0, F.concat(F.array_join("__heads", "・"), F.lit("連假"))).otherwise(plain))
        .withColumn("slug", F.date_format("start", "MMdd"))
        .drop("__heads")
    )


def _blocks(days: DataFrame, partition: Column | None, reach: int) -> DataFrame:
    by_year = Window.partitionBy("year").orderBy("d")
    by_kind = Window.partitionBy("year", "is_holiday").orderBy("d")
    rows = _year(days, partition).withColumn("rn", F.row_number().over(by_year))
    rows = (
        rows.withColumn("block", F.col("rn") - F.row_number().over(by_kind))
        .withColumn("before", F.array(*[F.lag("d", i).over(by_year) for i in range(reach, 0, -1)]))
        .withColumn("after", F.array(*[F.lead("d", i).over(by_year) for i in range(1, reach + 1)]))
    )
    return (
        rows.filter("is_holiday")
        .groupBy("year", "block")
        .agg(
            F.min("d").alias("start"),
            F.max("d").alias("end"),
            F.min("rn").alias("start_rn"),
            F.max("rn").alias("end_rn"),
            _named(F.col("memo") != IN_LIEU).alias("named"),
            F.min_by("before", "rn").alias("before"),
            F.max_by("after", "rn").alias("after"),
        )
    )


def holiday_blocks(days: DataFrame, partition: Column | None = None) -> DataFrame:
    """Runs of holidays on adjacent calendar *rows* (missing dates do not break a run), with the named days."""
    return _blocks(days, partition, 1).select("year", "start", "end", (F.col("end_rn") - F.col("start_rn") + 1).alias("rows"), "named")


def leave_plans(days: DataFrame, max_gap: int = 3, partition: Column | None = None) -> DataFrame:
    """Named blocks joined to the block before and after when 1..max_gap calendar rows lie between, and the days to take off."""
    w = Window.partitionBy("year").orderBy("start_rn")
    b = _blocks(days, partition, max_gap)
    b = (
        b.withColumn("gap_before", F.col("start_rn") - F.lag("end_rn").over(w) - 1)
        .withColumn("gap_after", F.lead("start_rn").over(w) - F.col("end_rn") - 1)
        .withColumn("prev_start", F.lag("start").over(w))
        .withColumn("next_end", F.lead("end").over(w))
    )
    left, right = F.coalesce(F.col("gap_before").between(1, max_gap), F.lit(False)), F.coalesce(F.col("gap_after").between(1, max_gap), F.lit(False))
    none = F.array().cast("array<date>")
    leave = F.concat(
        F.when(left, F.slice("before", max_gap + 1 - F.col("gap_before"), F.col("gap_before"))).otherwise(none),
        F.when(right, F.slice("after", F.lit(1), F.col("gap_after"))).otherwise(none),
    )
    return (
        b.filter((F.size("named") > 0) & (left | right))
        .select(
            "year",
            F.when(left, F.col("prev_start")).otherwise(F.col("start")).alias("start"),
            F.when(right, F.col("next_end")).otherwise(F.col("end")).alias("end"),
            leave.alias("leave_dates"),
            F.array_distinct("named").alias("anchor_names"),
        )
        .withColumn("total_days", F.datediff("end", "start") + 1)
    )


def described(plans: DataFrame, headlines: list[str] = HEADLINES, labels: dict[str, str] = SHORT_LABELS) -> DataFrame:
    """Adds the title and the sentence of a leave plan."""
    heads = headline(F.col("anchor_names"), headlines, labels)
    label = F.when(F.size(heads) > 0, heads).otherwise(F.transform("anchor_names", lambda n: short_label(n, labels)))
    return plans.withColumn("title", F.concat(F.array_join(label, "・"), F.lit("拼假攻略"))).withColumn(
        "sentence",
        F.concat(
            F.lit("請 "), F.size("leave_dates").cast("string"), F.lit(" 天特休("), F.array_join(F.col("leave_dates").cast("array<string>"), "、"),
            F.lit("),可連休 "), F.col("total_days").cast("string"), F.lit(" 天("), F.col("start").cast("string"), F.lit(" ~ "), F.col("end").cast("string"), F.lit(")。"),
        ),
    )


def totals(days: DataFrame, partition: Column | None = None) -> DataFrame:
    """Per year: days, holidays, in-lieu holidays and working weekend days (expected to be 0)."""
    return _year(days, partition).groupBy("year").agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if("is_holiday").alias("holiday_days"),
        F.count_if(F.col("memo") == IN_LIEU).alias("makeup_holidays"),
        F.count_if((F.col("weekday") >= 6) & ~F.col("is_holiday")).alias("makeup_workdays"),
    )


def holiday_dates(days: DataFrame) -> DataFrame:
    """Named holidays, in-lieu days included."""
    return days.filter(F.col("is_holiday") & (F.coalesce("memo", F.lit("")) != "")).select("d", "memo")


def next_interval(asof: DataFrame, as_of: str, intervals: DataFrame) -> DataFrame:
    """For each query date the first interval (start, end, ...) that has not ended; NULL columns when there is none.

    The intervals, tens per year, are turned into one row per date. The query rows are
    reduced to one per date first (``n_rows``), so neither side is range-joined.
    """
    dates = asof.groupBy(as_of).agg(F.count(F.lit(1)).alias("n_rows"))
    earliest = asof.agg(F.min(as_of)).scalar()
    lower = F.coalesce(F.date_add(F.lag("end").over(Window.orderBy("start")), 1), F.least(earliest, F.col("start")))
    lookup = (
        intervals.withColumn("__lower", lower).withColumn(as_of, F.explode(F.sequence("__lower", "end"))).drop("__lower")
    )
    return dates.join(lookup, as_of, "left")


def countdown(found: DataFrame, as_of: str) -> DataFrame:
    """Countdown line: days left, starts today, last day, or running until."""
    n = F.datediff("start", as_of)
    until = F.date_format("end", "MM/dd")
    title = F.col("title")
    return found.withColumn(
        "status", F.when(F.col("start").isNull(), "none").when(n > 0, "ahead").when(n == 0, "first_day").when(F.col("end") == F.col(as_of), "last_day").otherwise("running")
    ).withColumn(
        "line",
        F.when(F.col("start").isNull(), F.lit(None))
        .when(n > 0, F.concat(F.lit("下一個連假:"), title, F.lit(",還有 "), n.cast("string"), F.lit(" 天")))
        .when(n == 0, F.concat(F.lit("連假中:"), title, F.lit(",今天開始,放到 "), until))
        .when(F.col("end") == F.col(as_of), F.concat(F.lit("連假中:"), title, F.lit(",今天是最後一天")))
        .otherwise(F.concat(F.lit("連假中:"), title, F.lit(",放到 "), until)),
    )


def festival_check(days: DataFrame, weekends: DataFrame, names: list[str] = SOLO_FESTIVALS, labels: dict[str, str] = SHORT_LABELS) -> DataFrame:
    """Per year and festival: its first date and whether it lies in a long weekend of that year."""
    years = days.select(F.year("d").alias("year")).distinct().withColumn("memo", F.explode(F.array(*[F.lit(n) for n in names])))
    first = days.filter(F.col("memo").isin(names)).groupBy(F.year("d").alias("year"), "memo").agg(F.min("d").alias("d"))
    inside = weekends.select(F.explode(F.sequence("start", "end")).alias("d")).withColumn("forms_long_weekend", F.lit(True))
    out = years.join(first, ["year", "memo"], "left").join(inside, "d", "left")
    return out.select("year", short_label(F.col("memo"), labels).alias("name"), "d", F.coalesce("forms_long_weekend", F.lit(False)).alias("forms_long_weekend"))


def interval_days(intervals: DataFrame) -> DataFrame:
    """One row per date of each interval."""
    return intervals.withColumn("d", F.explode(F.sequence("start", "end")))
