"""Comparing a home calendar with the holidays of other countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.operators.calendar import interval_days

# Display names of English holiday names.
HOLIDAY_ZH = {
    "New Year’s Day": "元旦",
    "Chinese New Year": "農曆新年",
    "Hari Raya Puasa": "開齋節",
    "Good Friday": "耶穌受難日",
    "Labour Day": "勞動節",
    "Hari Raya Haji": "哈芝節",
    "Vesak Day": "衛塞節",
    "National Day": "新加坡國慶日",
    "Deepavali": "屠妖節",
    "Christmas Day": "聖誕節",
}
OBSERVED = r" \(Observed\)$"


def display_name(name: Column, mapping: dict[str, str] = HOLIDAY_ZH) -> Column:
    """Mapped name with the original in brackets, marked when observed on another day; unmapped names stay."""
    base = F.regexp_replace(name, OBSERVED, "")
    zh = F.coalesce(*[F.when(base == k, F.lit(v)) for k, v in mapping.items()])
    mark = F.when(name.rlike(OBSERVED), F.lit("補假")).otherwise("")
    return F.coalesce(F.concat(zh, mark, F.lit("("), name, F.lit(")")), name)


def home_label() -> Column:
    """Label of a home day after a left join: not in the calendar, make-up work, work, the memo or a weekend."""
    return (
        F.when(F.col("is_holiday").isNull(), "—")
        .when(~F.col("is_holiday"), F.when(F.col("weekday") >= 6, "補班").otherwise("上班"))
        .otherwise(F.coalesce(F.nullif("memo", F.lit("")), F.lit("週末")))
    )


def holidays_by_day(foreign: DataFrame, countries: list[str]) -> DataFrame:
    """One row per date with the sorted distinct names of each country."""
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col("country") == c, F.col("name"))))
    return foreign.groupBy("d").agg(*[names(c).alias(f"{c}_names") for c in countries])


def closure_dates(days: DataFrame, rules: DataFrame, foreign: DataFrame) -> DataFrame:
    """Calendar days inside a country's closure window that are not its national holidays.

    The window is spelled out as its MM-dd values, so the calendar meets it by equality.
    """
    start, end = F.to_date(F.concat(F.lit("2000-"), "start_md")), F.to_date(F.concat(F.lit("2000-"), "end_md"))
    last = F.when(F.col("start_md") > F.col("end_md"), F.add_months(end, 12)).otherwise(end)
    window = rules.select("country", F.explode(F.sequence(start, last)).alias("x")).select("country", F.date_format("x", "MM-dd").alias("md")).distinct()
    hits = days.withColumn("md", F.date_format("d", "MM-dd")).join(window, "md").drop("md")
    return hits.join(foreign.select("country", "d").distinct(), ["country", "d"], "left_anti")


def compare_days(weekends: DataFrame, days: DataFrame, foreign: DataFrame, closures: DataFrame, countries: list[str]) -> DataFrame:
    """Each day of each long weekend with the home label, the foreign holidays and the closure flag."""
    spine = interval_days(weekends.select("year", "start", "end"))
    closed = closures.select("d").distinct().withColumn("closed", F.lit(True))
    out = spine.join(days, "d", "left").join(holidays_by_day(foreign, countries), "d", "left").join(closed, "d", "left")
    return out.select(
        "year",
        "start",
        "d",
        home_label().alias("home"),
        *[F.coalesce(F.col(f"{c}_names"), F.array().cast("array<string>")).alias(f"{c}_names") for c in countries],
        F.coalesce("closed", F.lit(False)).alias("closed"),
    )


def per_weekend(compared: DataFrame, countries: list[str]) -> DataFrame:
    """Days with a holiday per country and closure days, for each long weekend."""
    return compared.groupBy("year", "start").agg(
        *[F.count_if(F.size(f"{c}_names") > 0).alias(f"{c}_days") for c in countries], F.count_if("closed").alias("closure_days")
    )


def weekend_sentence(counted: DataFrame, weekends: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Adds one sentence per long weekend: its dates, length and the foreign holidays in it."""

    def part(c: str) -> Column:
        n = F.col(f"{c}_days")
        return F.when(n > 0, F.concat(F.lit(f"{labels[c]}有 "), n.cast("string"), F.lit(" 天是當地國定假日"))).otherwise(F.lit(f"{labels[c]}沒有當地國定假日"))

    joined = counted.join(weekends.select("year", "start", "end", "days"), ["year", "start"])
    text = F.concat(
        F.col("start").cast("string"), F.lit(" 至 "), F.col("end").cast("string"), F.lit("("), F.col("days").cast("string"), F.lit(" 天):"),
        F.array_join(F.array(*[part(c) for c in labels]), ";"), F.lit("。"),
    )
    return joined.withColumn("sentence", text)


def workday_holidays(days: DataFrame, foreign: DataFrame) -> DataFrame:
    """Foreign holidays on home working days; ``makeup`` marks a worked weekend. Dates outside the calendar drop out."""
    return foreign.join(days, "d").filter(~F.col("is_holiday")).select("country", "d", "name", (F.col("weekday") >= 6).alias("makeup"))


def compare_year(weekends: DataFrame, days: DataFrame, foreign: DataFrame, closures: DataFrame, countries: list[str], labels: dict[str, str]) -> DataFrame:
    """Per calendar year: long weekends with foreign holidays, national-holiday days, workday overlaps, closures and the summary sentence."""
    lw = per_weekend(compare_days(weekends, days, foreign, closures, countries), countries).groupBy("year").agg(
        F.count(F.lit(1)).alias("long_weekends"), *[F.count_if(F.col(f"{c}_days") > 0).alias(f"{c}_weekends") for c in countries]
    )
    of = lambda c: F.when(F.col("country") == c, F.col("d"))
    national = foreign.groupBy(F.year("d").alias("year")).agg(*[F.count_distinct(of(c)).alias(f"{c}_national") for c in countries])
    overlaps = workday_holidays(days, foreign).groupBy(F.year("d").alias("year")).agg(
        *[F.count_if(F.col("country") == c).alias(f"{c}_workday") for c in countries],
        *[F.count_if((F.col("country") == c) & F.col("makeup")).alias(f"{c}_makeup") for c in countries],
    )
    closed = closures.groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("closure_dates"), F.count_if(~F.col("is_holiday")).alias("closure_workdays"))
    out = days.select(F.year("d").alias("year")).distinct()
    for part in (lw, national, overlaps, closed):
        out = out.join(part, "year", "left")
    out = out.na.fill(0)
    text = lambda c: F.col(c).cast("string")
    shares = F.array_join(F.array(*[F.concat(text(f"{c}_weekends"), F.lit(f" 個連假期間{labels[c]}有當地國定假日")) for c in countries]), ",")

    def workday(c: str) -> Column:
        base = F.concat(text("year"), F.lit(f" 年{labels[c]}當地國定假日共 "), text(f"{c}_national"), F.lit(" 天,其中 "), text(f"{c}_workday"), F.lit(" 天台灣當天要上班"))
        makeup = F.concat(F.lit("(含 "), text(f"{c}_makeup"), F.lit(" 天為台灣週末補班日)"))
        return F.concat(base, F.when(F.col(f"{c}_makeup") > 0, makeup).otherwise(""), F.lit("。"))

    closed_text = F.concat(
        text("year"), F.lit(" 年落在 12/29–12/31 與 1/1–1/3 區間、且不是日本國民の祝日的日期共 "), text("closure_dates"), F.lit(" 天,其中 "), text("closure_workdays"), F.lit(" 天台灣當天要上班。")
    )
    summary = F.concat(text("year"), F.lit(" 年台灣有 "), text("long_weekends"), F.lit(" 個 3 天以上連假;其中 "), shares, F.lit("。"))
    return out.select(
        "*", summary.alias("summary"), *[workday(c).alias(f"{c}_sentence") for c in countries], closed_text.alias("closure_sentence")
    )
