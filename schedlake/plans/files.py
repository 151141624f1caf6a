"""Queries that write the raw formats and read them back through their readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions.times import WEEKDAY_CHARS
from schedlake.oracle_views import WEEKDAY_SQL
from schedlake.plans.registry import query
from schedlake.sources import readers, sinks
from schedlake.streaming.landing import landing_dirs

#: Records of one envelope document.
RECORDS = 500


@query("calendar_files", "v_calendar", sql=f"""
SELECT d, weekday, {WEEKDAY_SQL}[weekday] AS weekday_char, CASE WHEN is_holiday THEN '2' ELSE '0' END AS code, is_holiday, memo FROM v_calendar""")
def calendar_files(v):
    """Office calendar as CSV with its header, dates without separators."""
    path, _ = landing_dirs(v.spark)
    char = F.get(F.array(*[F.lit(c) for c in WEEKDAY_CHARS]), F.col("weekday") - 1)
    values = [F.date_format("d", "yyyyMMdd"), char, F.when(F.col("is_holiday"), "2").otherwise("0"), F.col("memo")]
    rows = v.calendar().select(*[value.alias(name) for value, name in zip(values, readers.CALENDAR_HEADER)])
    sinks.write_csv(rows, path, readers.CALENDAR_HEADER, readers.CALENDAR_HEADER[:1])
    return readers.office_calendar(v.spark, path)


@query("yearly_holiday_files", "v_foreign", sql="SELECT country, d, name FROM v_foreign WHERE country = 'sg'")
def yearly_holiday_files(v):
    """Holidays of a country, one folder per year, each row checked against its year and weekday."""
    path, _ = landing_dirs(v.spark)
    values = [F.col("d"), F.date_format("d", "EEEE"), F.col("name")]
    rows = v.foreign().filter("country = 'sg'").select(F.year("d").alias("year"), *[value.alias(name) for value, name in zip(values, readers.SG_HEADER)])
    rows.write.partitionBy("year").csv(path, header=True)
    years = [r.year for r in v.spark.read.csv(path, header=True).select(F.col("year").cast("int")).distinct().collect()]
    return readers.sg_holidays(v.spark, {year: f"{path}/year={year}" for year in years})


LUNAR_COLUMNS = ["solar_date", "lunar_year", "lunar_month", "lunar_day", "is_leap_month", "lunar_month_label", "lunar_day_label", "ganzhi", "zodiac", "solar_term"]


@query("lunar_files", "v_lunar", sql=f"SELECT {', '.join(LUNAR_COLUMNS)} FROM v_lunar")
def lunar_files(v):
    """Daily lunar dimension as CSV with lower-case booleans."""
    path, _ = landing_dirs(v.spark)
    sinks.write_csv(v.lunar_days(), path, LUNAR_COLUMNS, ["solar_date"])
    return readers.lunar_days(v.spark, path)


@query("occasion_files", "v_occasions", sql="""
SELECT deity_name, common_name, occasion_type, honorific_source, honorific_source AS source_1, CAST(NULL AS VARCHAR) AS source_2,
  CASE WHEN ord % 2 = 0 THEN 'https://example.org/' || ord END AS source_3, lunar_month, lunar_day FROM v_occasions""")
def occasion_files(v):
    """Occasions as CSV with optional sources."""
    path, _ = landing_dirs(v.spark)
    link = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://example.org/"), F.col("ord").cast("string")))
    rows = v.occasions().withColumn("source_1", F.col("honorific_source")).withColumn("source_2", F.lit(None).cast("string")).withColumn("source_3", link)
    columns = ["deity_name", "common_name", "occasion_type", "honorific_source", "source_1", "source_2", "source_3", "lunar_month", "lunar_day"]
    sinks.write_csv(rows, path, columns, ["common_name", "lunar_month", "lunar_day"])
    return readers.occasions(v.spark, path)


@query("envelope_files", "v_points", sql=f"""
SELECT city_slug AS env_city, 'batch ' || (ord // {RECORDS}) AS env_source, '2026-12-01' AS env_fetched_at, ord AS key, district, point_name,
  count(*) OVER () AS n_numbers, CAST(0 AS BIGINT) AS first_number, count(*) OVER () - 1 AS last_number FROM v_points""")
def envelope_files(v):
    """Points as documents of at most RECORDS records, one per file; the numbers of the records run from 0 without a gap."""
    path, _ = landing_dirs(v.spark)
    batch = F.concat(F.lit("batch "), F.floor(F.col("ord") / RECORDS).cast("string"))
    records = v.points().select(F.col("city_slug").alias("city"), batch.alias("source"), F.struct(F.col("ord").alias("key"), "district", "point_name").alias("r"))
    documents = records.groupBy("city", "source").agg(F.lit("2026-12-01").alias("fetched_at"), F.collect_list("r").alias("records"))
    documents.write.option("maxRecordsPerFile", 1).json(path)
    rows = readers.envelope(v.spark, path, "struct<key:bigint,district:string,point_name:string>")
    numbers = rows.agg(F.count_distinct("ord").alias("n_numbers"), F.min("ord").alias("first_number"), F.max("ord").alias("last_number")).first()
    return rows.drop("ord").select("*", *[F.lit(value).cast("long").alias(name) for name, value in numbers.asDict().items()])


@query("id_map_versions", "v_points", sql="SELECT ord, point_id || '-new' AS point_id FROM v_points WHERE ord % 3 <> 0")
def id_map_versions(v):
    """Two versions of the id map; the newest is the one with the larger number, not the later text."""
    path, _ = landing_dirs(v.spark)
    ids = v.points().select("ord", "point_id")
    sinks.write_version(ids.filter("ord % 3 <> 0").withColumn("point_id", F.concat("point_id", F.lit("-new"))), path, "2026-10")
    sinks.write_version(ids, path, "2026-9")
    return readers.snapshot(v.spark, path)
