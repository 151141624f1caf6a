"""Lunar dates: occasions, festivals, lookups, segments and their checks.

Everything is computed on the daily dimension or on (month, day, year) keys, at most 360 per
year; the occasions, which may be many, only meet the finished result by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.dates import folk_month, lunar_day_label, weekday_label
from schedlake.functions.text import map_value
from schedlake.operators.quality import require_empty
from schedlake.operators.skew import first_rows
from schedlake.session import cut_lineage

# Months whose dates may fall twice or never into a solar year, and the festivals by lunar date.
BOUNDARY_MONTHS = [10, 11, 12]
FESTIVALS = [
    (1, 1, "正月初一"), (1, 2, "正月初二"), (1, 3, "正月初三"), (1, 4, "正月初四"), (1, 5, "正月初五"), (1, 15, "元宵"),
    (5, 5, "端午"), (7, 7, "七夕"), (7, 15, "中元"), (8, 15, "中秋"), (9, 9, "重陽"),
]
TERM_FESTIVALS = ["清明", "冬至"]
# Simplified names whose traditional form differs.
TERM_FORMS = {"惊蛰": "驚蟄", "谷雨": "穀雨", "小满": "小滿", "芒种": "芒種", "处暑": "處暑"}
ZODIAC_FORMS = {"龙": "龍", "马": "馬", "鸡": "雞", "猪": "豬"}
ZODIACS = ["鼠", "牛", "虎", "兔", "龍", "蛇", "馬", "羊", "猴", "雞", "狗", "豬"]

MD = ["lunar_month", "lunar_day"]


def _regular(lunar: DataFrame) -> DataFrame:
    return lunar.filter(~F.col("is_leap_month")).select(
        *MD, F.year("solar_date").alias("solar_year"), "solar_date", F.concat("lunar_month_label", "lunar_day_label").alias("lunar_label")
    )


def month_day_years(occasions: DataFrame, first_year: Column, last_year: Column) -> DataFrame:
    """Distinct lunar (month, day) of the occasions for every solar year of the range."""
    return occasions.select(*MD).distinct().withColumn("solar_year", F.explode(F.sequence(first_year, last_year)))


def solar_dates(keys: DataFrame, lunar: DataFrame) -> DataFrame:
    """All solar dates of (month, day, year); day 30 falls back to day 29 only in a year without any day 30."""
    days = _regular(lunar)
    join_on = [*MD, "solar_year"]
    direct = keys.join(days, join_on).withColumn("adjusted", F.lit(False))
    missing = keys.filter("lunar_day = 30").join(days, join_on, "left_anti")
    day29 = days.filter("lunar_day = 29").drop("lunar_day")
    fallback = missing.join(day29, ["lunar_month", "solar_year"]).withColumn("adjusted", F.lit(True))
    return direct.unionByName(fallback)


def occasion_dates(occasions: DataFrame, lunar: DataFrame, first_year: Column, last_year: Column, ord_col: str = "ord") -> DataFrame:
    """Occasions with every solar date of the years, weekday, label and the adjustment note."""
    dates = solar_dates(month_day_years(occasions, first_year, last_year), lunar)
    month = F.col("lunar_month").cast("string")
    note = F.concat(F.col("solar_year").cast("string"), F.lit(" 年農曆"), month, F.lit("月僅 29 日,以"), month, F.lit("月廿九為準"))
    dates = dates.withColumn("adjust_note", F.when(F.col("adjusted"), note).otherwise("")).withColumn("weekday", weekday_label(F.col("solar_date"), "星期"))
    return occasions.join(dates, MD, "inner")


def exceptions(occasions: DataFrame, lunar: DataFrame, first_year: Column, last_year: Column) -> DataFrame:
    """(month, day, year) with a substituted day, or with none or several dates; outside months 10-12 the latter are 'unexpected'."""
    keys = month_day_years(occasions, first_year, last_year)
    hits = solar_dates(keys, lunar).groupBy(*MD, "solar_year").agg(F.count(F.lit(1)).alias("n"), F.bool_or("adjusted").alias("adjusted"))
    counted = keys.join(hits, [*MD, "solar_year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    odd = F.when(F.col("lunar_month").isin(BOUNDARY_MONTHS), "type_year_boundary").otherwise("unexpected")
    types = F.array_compact(F.array(F.when(F.coalesce("adjusted", F.lit(False)), "type_29_30"), F.when(F.col("n") != 1, odd)))
    return counted.withColumn("type", F.explode(types)).select(*MD, "solar_year", "type", "n")


def require_known(found: DataFrame) -> None:
    """Stops when an exception of an unknown kind exists."""
    from schedlake.operators.quality import require_empty

    require_empty(found.filter("type = 'unexpected'"), "unexpected lunar dates")


def around_missing(occasions: DataFrame, lunar: DataFrame, first_year: Column, last_year: Column) -> DataFrame:
    """For (month, day, year) without a date: the last date before and the first after that year."""
    keys = month_day_years(occasions, first_year, last_year)
    days = _regular(lunar)
    missing = keys.join(days, [*MD, "solar_year"], "left_anti")
    others = days.select(*MD, F.col("solar_year").alias("other_year"), "solar_date")
    return (
        missing.join(others, MD, "left")
        .groupBy(*MD, "solar_year")
        .agg(
            F.max(F.when(F.col("other_year") < F.col("solar_year"), F.col("solar_date"))).alias("previous"),
            F.min(F.when(F.col("other_year") > F.col("solar_year"), F.col("solar_date"))).alias("next"),
        )
    )


def festivals(lunar: DataFrame) -> DataFrame:
    """Festival dates by lunar year. The eve is the day before the next new year; term festivals come from the solar terms."""
    names = F.coalesce(*[F.when((F.col("lunar_month") == m) & (F.col("lunar_day") == d), F.lit(n)) for m, d, n in FESTIVALS])
    regular = lunar.filter(~F.col("is_leap_month"))
    fixed = regular.withColumn("festival", names).filter("festival is not null").select("lunar_year", "festival", "solar_date")
    eve = regular.filter("lunar_month = 1 and lunar_day = 1").select(
        (F.col("lunar_year") - 1).alias("lunar_year"), F.lit("除夕").alias("festival"), F.date_sub("solar_date", 1).alias("solar_date")
    )
    terms = lunar.filter(F.col("solar_term").isin(TERM_FESTIVALS)).groupBy("lunar_year", F.col("solar_term").alias("festival")).agg(F.max("solar_date").alias("solar_date"))
    return fixed.unionByName(eve).unionByName(terms).withColumn("solar_year", F.year("solar_date"))


def missing_terms(lunar: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(lunar_year, festival) of the term festivals that the daily dimension lacks in the years asked for."""
    years = lunar.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("lunar_year"))
    wanted = years.withColumn("festival", F.explode(F.array(*map(F.lit, TERM_FESTIVALS))))
    have = lunar.filter(F.col("solar_term").isin(TERM_FESTIVALS)).select("lunar_year", F.col("solar_term").alias("festival")).distinct()
    return wanted.join(have, ["lunar_year", "festival"], "left_anti")


def complete_festivals(lunar: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Festivals of the years asked for; stops when a term festival is missing in one of them."""
    require_empty(missing_terms(lunar, first_year, last_year), "solar terms missing")
    return festivals(lunar).filter(F.col("lunar_year").between(first_year, last_year))


def to_lunar(dates: DataFrame, d: str, lunar: DataFrame) -> DataFrame:
    """Lunar date of each distinct query date with the number of rows asking."""
    asked = dates.groupBy(d).agg(F.count(F.lit(1)).alias("n_rows"))
    return asked.join(lunar.withColumnRenamed("solar_date", d), d, "left")


def to_solar(requests: DataFrame, lunar: DataFrame, first_year: Column, last_year: Column, ord_col: str = "ord") -> DataFrame:
    """Requests (month, day, leap) for every lunar year; ``not_exist`` where the year has no such date."""
    keys = [*MD, "is_leap_month"]
    years = requests.select(*keys).distinct().withColumn("lunar_year", F.explode(F.sequence(first_year, last_year)))
    dates = years.join(lunar.select(*keys, "lunar_year", "solar_date"), [*keys, "lunar_year"], "left").withColumn("not_exist", F.col("solar_date").isNull())
    return requests.join(dates, keys, "inner")


def signed_month(month: Column) -> tuple[Column, Column]:
    """(month, is leap) of a month written negative when it is a leap month."""
    return F.abs(month), month < 0


def segments(lunar: DataFrame) -> DataFrame:
    """Daily rows compressed to one row per lunar month: start, first lunar day and number of days."""
    return lunar.groupBy("lunar_year", "lunar_month", "is_leap_month").agg(
        F.min("solar_date").alias("start"),
        F.min_by("ganzhi", "solar_date").alias("year_name"),
        F.min_by("lunar_month_label", "solar_date").alias("month_label"),
        F.min_by("lunar_day", "solar_date").alias("first_day"),
        F.count(F.lit(1)).cast("int").alias("days"),
    )


def segment_lookup(asof: DataFrame, as_of: str, segs: DataFrame) -> DataFrame:
    """Lunar line of each query date by its month segment; dates outside all segments have no row.

    The segments are unrolled to dates, so the query rows meet them by equality.
    """
    days = segs.select("*", F.posexplode(F.sequence("start", F.date_add("start", F.col("days") - 1))).alias("offset", as_of))
    asked = asof.groupBy(as_of).agg(F.count(F.lit(1)).alias("n_rows"))
    label = lunar_day_label(F.col("first_day") + F.col("offset"))
    line = F.concat(F.lit("今天農曆:"), "year_name", F.lit("年"), "month_label", label)
    return asked.join(days, as_of).withColumn("line", line).filter("line is not null").select(as_of, "n_rows", "offset", "line")


def year_summary(lunar: DataFrame) -> DataFrame:
    """Days, leap month (0 = none) and range of each lunar year, with the leap month's own range."""
    months = lunar.groupBy("lunar_year", "lunar_month", "is_leap_month").agg(
        F.count(F.lit(1)).alias("days"), F.min("solar_date").alias("start"), F.max("solar_date").alias("end")
    )
    leap = F.col("is_leap_month")
    return months.groupBy("lunar_year").agg(
        F.sum("days").alias("days"),
        F.count(F.lit(1)).alias("months"),
        F.max(F.when(leap, F.col("lunar_month")).otherwise(0)).alias("leap_month"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min(F.when(leap, F.col("start"))).alias("leap_start"),
        F.max(F.when(leap, F.col("end"))).alias("leap_end"),
    )


def checks(lunar: DataFrame, leap_years: list[int], terms: list[str]) -> DataFrame:
    """One row per self-check of the daily dimension: name, passed and the observed figure."""
    row = lambda df, name, passed, seen: df.select(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), seen.cast("long").alias("observed"))
    listed = lambda values: F.sort_array(F.array(*[F.lit(v) for v in values]))

    span = lunar.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("solar_date").alias("u"), (F.datediff(F.max("solar_date"), F.min("solar_date")) + 1).alias("days"))
    months = segments(lunar).withColumn("end", F.date_add("start", F.col("days") - 1))
    edge = lunar.agg(F.min("solar_date").alias("lo"), F.max("solar_date").alias("hi"))
    lo, hi = edge.select("lo").scalar(), edge.select("hi").scalar()
    bad_months = months.filter((F.col("start") != lo) & (F.col("end") != hi) & ~F.col("days").isin(29, 30)).agg(F.count(F.lit(1)).alias("n"))
    years = lunar.groupBy(F.year("solar_date").alias("y")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("solar_term") != "").alias("terms"))
    bad_terms = years.filter((F.col("days") >= 365) & (F.col("terms") != 24)).agg(F.count(F.lit(1)).alias("n"))
    names = lunar.filter("solar_term <> ''").agg(F.sort_array(F.collect_set("solar_term")).alias("s"))
    zodiacs = lunar.agg(F.collect_set("zodiac").alias("s"))
    leaps = lunar.filter("is_leap_month").agg(F.sort_array(F.collect_set("lunar_year")).alias("s"))
    f = festivals(lunar)
    eves = f.filter("festival = '除夕'").select((F.col("lunar_year") + 1).alias("lunar_year"), F.date_add("solar_date", 1).alias("expected"))
    new_years = f.filter("festival = '正月初一'").select("lunar_year", "solar_date")
    broken = new_years.join(eves, "lunar_year", "left").filter("expected is null or expected <> solar_date").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        row(span, "days_complete", (F.col("n") == F.col("days")) & (F.col("u") == F.col("n")), F.col("n")),
        row(bad_months, "month_length", F.col("n") == 0, F.col("n")),
        row(bad_terms, "terms_per_year", F.col("n") == 0, F.col("n")),
        row(names, "term_names", F.col("s") == listed(terms), F.size("s")),
        row(zodiacs, "zodiac_names", F.size(F.array_except("s", listed(ZODIACS))) == 0, F.size("s")),
        row(leaps, "leap_years", F.col("s") == F.array(*[F.lit(y) for y in sorted(leap_years)]), F.size("s")),
        row(broken, "eve_before_new_year", F.col("n") == 0, F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def running_before(counts: DataFrame, d: str, n: str) -> DataFrame:
    """Sum of ``n`` over all earlier dates: inside the year, plus the totals of the earlier years (one row per year)."""
    by_year = counts.withColumn("__y", F.year(d))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__y").orderBy(d).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    years = by_year.groupBy("__y").agg(F.sum(n).alias("__t"))
    earlier = F.coalesce(F.sum("__t").over(Window.orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by_year.join(years.withColumn("__e", earlier).drop("__t"), "__y").withColumn("before", inside + F.col("__e")).drop("__y", "__e")


def upcoming(asof: DataFrame, as_of: str, events: DataFrame, d: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` events on or after each distinct query date.

    Only the first ``limit`` events of one date can be among them, which bounds the events by
    the calendar. Positions come from running counts per date, and the answer is an equality
    join on the position.
    """
    # read by the counts per date and by the placement
    kept = cut_lineage(first_rows(events, [d], [order], limit, "__r"))
    per_day = kept.groupBy(d).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(d, as_of)
    asked = asof.groupBy(as_of).agg(F.count(F.lit(1)).alias("n_rows"))
    line = asked.select(as_of).unionByName(per_day.select(as_of)).distinct().join(per_day, as_of, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    before = running_before(line, as_of, "__n").select(as_of, "before")
    placed = kept.join(before.withColumnRenamed(as_of, d), d).withColumn("__pos", F.col("before") + F.col("__r")).drop("before", "__r")
    wanted = asked.join(before, as_of).select(as_of, "n_rows", F.posexplode(F.sequence(F.col("before") + 1, F.col("before") + limit)).alias("rank", "__pos"))
    return wanted.join(placed, "__pos").drop("__pos").withColumn("rank", F.col("rank") + 1)


#: Schemas of the optional tables of ``documents``.
NOTES = "deity_name string, lunar_month int, lunar_day int, occasion_type string, note string"
SUBSTITUTIONS = "deity_name string, lunar_month int, lunar_day int, substitution string"
SOURCES = ["source_1", "source_2", "source_3"]


def documents(
    occasions: DataFrame, dates: DataFrame, ord_col: str = "ord", notes: DataFrame | None = None, substitutions: DataFrame | None = None, hosts: dict[str, str] | None = None
) -> DataFrame:
    """Entity documents: occasions sorted by lunar date, each with its sources, note, substitution rule and dates in order.

    The first row of an occasion key stands for it, so an entity has at most one element per
    (month, day, type). An honorific equal to the type says nothing and becomes NULL. Source columns that the occasions
    have become (url, name); the name is the host's in ``hosts``, else the host. The source of the substitution rule is
    shown only where a date was moved from day 30.
    """
    spark = occasions.sparkSession
    key = ["deity_name", *MD, "occasion_type"]
    urls = [c for c in SOURCES if c in occasions.columns]
    first = occasions.groupBy(*key).agg(F.min_by(F.struct("common_name", "honorific_source", *urls), ord_col).alias("r")).select(*key, "r.*")
    first = first.withColumn("honorific", F.nullif("honorific_source", "occasion_type"))
    listed = F.filter(F.array(*[F.nullif(u, F.lit("")) for u in urls]).cast("array<string>"), lambda u: u.isNotNull())
    host = lambda u: F.parse_url(u, F.lit("HOST"))
    first = first.withColumn("sources", F.transform(listed, lambda u: F.struct(u.alias("url"), map_value(host(u), hosts or {"": ""}, host(u)).alias("name"))))
    notes = notes if notes is not None else spark.createDataFrame([], NOTES)
    substitutions = substitutions if substitutions is not None else spark.createDataFrame([], SUBSTITUTIONS)
    first = first.join(notes, key, "left").join(substitutions, ["deity_name", *MD], "left")
    per_day = dates.groupBy(*MD).agg(
        F.sort_array(F.collect_set(F.struct("solar_date", "solar_year", "weekday", "adjusted", "adjust_note"))).alias("dates"),
        F.max_by("lunar_label", F.struct(~F.col("adjusted"), "solar_date")).alias("lunar_label"),
        F.bool_or("adjusted").alias("moved"),
    )
    joined = first.join(per_day, MD, "left")
    element = F.struct(
        *MD, folk_month(F.col("lunar_label")).alias("lunar_label"), "occasion_type", "honorific", "sources", "note",
        F.when(F.col("moved"), F.col("substitution")).alias("thirty_day_substitution"), "dates",
    )
    return joined.groupBy("deity_name").agg(F.min("common_name").alias("common_name"), F.sort_array(F.collect_list(element)).alias("occasions"))


def document_problems(docs: DataFrame, substitutions: DataFrame) -> DataFrame:
    """(deity_name, lunar_month, lunar_day, problem): occasions without dates or label, a moved date without a source for the rule,
    and rules for an occasion that does not exist."""
    each = docs.select("deity_name", F.inline("occasions"))
    moved = F.exists(F.coalesce("dates", F.array()), lambda d: d["adjusted"])
    problem = (
        F.when(F.coalesce(F.size("dates"), F.lit(0)) == 0, "no_dates")
        .when(F.col("lunar_label").isNull(), "no_label")
        .when(moved & F.col("thirty_day_substitution").isNull(), "substitution_without_source")
    )
    found = each.select("deity_name", *MD, problem.alias("problem")).filter("problem is not null")
    key = ["deity_name", *MD]
    stale = substitutions.select(*key).distinct().join(each.select(*key).distinct(), key, "left_anti").withColumn("problem", F.lit("stale_substitution"))
    return found.unionByName(stale)


def complete_documents(docs: DataFrame, substitutions: DataFrame) -> DataFrame:
    """The documents, or a stop when one has a gap."""
    require_empty(document_problems(docs, substitutions), "incomplete documents")
    return docs


def flatten_documents(docs: DataFrame) -> DataFrame:
    """Back to one row per entity, occasion and date."""
    return docs.select("deity_name", F.inline("occasions")).select("deity_name", *MD, "lunar_label", "occasion_type", F.inline("dates"))
