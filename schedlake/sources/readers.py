"""Readers of the raw formats. Each declares its schema; none infers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.functions.text import strip

WIDE_DAYS = "struct<area:string,village:string,caption:string,task_type:string,car_licence:string," + ",".join(
    f"{p}_d{i}_time_{s}:string" for p in "gr" for i in range(1, 8) for s in "se"
) + ">"
FLAG_DAYS = "struct<city:string,village:string,name:string,time:string,latitude:string,longitude:string,memo:string,lineid:string," + ",".join(
    f"{p}{d}:string"
    for p in ("garbage", "recycling", "foodscraps")
    for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
) + ">"
STOP = (
    "struct<gid:string,poi_id:bigint,poi_name:string,seq:bigint,shift:string,memo:string,lat:double,lng:double,arrive_time:string,"
    "show_arrive_time:string,show_memo_time:string,show_memo:string,show_recycle_arrive_time:string,show_recycle_memo_time:string>"
)
ROUTE = "struct<routing_id:string,routing_name:string,run_type:string,seq:bigint,car1:string,ver:bigint>"
STOP_FILE = r"^(.+)__(.+)__(lagi|recycle)\.json$"

# Column names of the calendar and holiday files.
CALENDAR_HEADER = ["西元日期", "星期", "是否放假", "備註"]
JP_HEADER = ["国民の祝日・休日月日", "国民の祝日・休日名称"]
SG_HEADER = ["date", "day", "holiday"]
LUNAR_SCHEMA = (
    "solar_date date, lunar_year int, lunar_month int, lunar_day int, is_leap_month boolean, lunar_month_label string, "
    "lunar_day_label string, ganzhi string, zodiac string, solar_term string"
)
OCCASION_SCHEMA = (
    "deity_name string, common_name string, occasion_type string, honorific_source string, source_1 string, source_2 string, source_3 string, "
    "lunar_month int, lunar_day int"
)


def envelope(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Documents {city, source, fetched_at, records[]}, one per file: one row per record with the envelope fields.

    ``ord`` numbers the records of all documents in order of file and place. A document is read by one task;
    many documents are read in parallel, and only one row per file is ranked.
    """
    docs = spark.read.schema(f"city string, source string, fetched_at string, records array<{record}>").json(path, multiLine=True)
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    sizes = docs.groupBy("file").agg(F.sum(F.coalesce(F.size("records"), F.lit(0))).alias("records"))
    before = F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = [F.col("city").alias("env_city"), F.col("source").alias("env_source"), F.col("fetched_at").alias("env_fetched_at")]
    rows = docs.select("file", *head, F.posexplode("records").alias("pos", "r")).join(sizes.select("file", before.alias("start")), "file")
    return rows.select("env_city", "env_source", "env_fetched_at", (F.col("start") + F.col("pos")).cast("long").alias("ord"), "r.*")


def stop_files(spark: SparkSession, directory: str, zone: str = "Asia/Taipei") -> DataFrame:
    """Stops of all ``{gid}__{route}__{type}.json`` files with the keys of the file name and its local modification midnight.

    Other names are skipped, an empty ``result`` gives no rows.
    A filter on a key of the file name reaches the file listing, so files of other keys are not opened.
    """
    docs = spark.read.schema(f"errCode string, msg string, result array<{STOP}>").option("pathGlobFilter", "*__*__*.json").json(directory, multiLine=True)
    name = F.col("_metadata.file_name")
    day = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.col("modified"), F.current_timezone()), zone), "yyyy-MM-dd")
    named = docs.select(name.alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "result").filter(F.col("file").rlike(STOP_FILE))
    return named.select(
        "file",
        F.regexp_extract("file", STOP_FILE, 1).alias("file_gid"),
        F.regexp_extract("file", STOP_FILE, 2).alias("route_id"),
        F.regexp_extract("file", STOP_FILE, 3).alias("car_type"),
        F.concat(day, F.lit("T00:00:00+08:00")).alias("fetched_at"),
        F.posexplode("result").alias("pos", "r"),
    ).select("file", "file_gid", "route_id", "car_type", "fetched_at", "pos", "r.*")


def route_lists(spark: SparkSession, directory: str) -> DataFrame:
    """Route dimension: the file stem is the district; of several rows per route the one of the last file wins."""
    docs = spark.read.schema(f"result array<{ROUTE}>").json(directory, multiLine=True)
    rows = docs.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("district_gid"), F.posexplode("result").alias("pos", "r"))
    picked = F.max_by(F.struct("district_gid", "r"), F.struct("district_gid", "pos")).alias("x")
    return rows.groupBy(F.col("r.routing_id").alias("routing_id")).agg(picked).select("routing_id", "x.district_gid", "x.r.run_type", "x.r.car1", "x.r.routing_name")


def _csv(spark: SparkSession, paths, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Strict CSV: every file's header must be exactly ``columns`` (a byte order mark is allowed), a wrong field count fails."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(paths, header=True, mode="FAILFAST", encoding=encoding, enforceSchema=False)


def office_calendar(spark: SparkSession, paths) -> DataFrame:
    """Office calendar: (d, weekday, weekday_char, code, is_holiday, memo). Code 2 is a holiday, 0 a working day."""
    raw = _csv(spark, paths, CALENDAR_HEADER)
    date, char, code, memo = (strip(F.col(c)) for c in CALENDAR_HEADER)
    return raw.select(F.to_date(date, "yyyyMMdd").alias("d"), char.alias("weekday_char"), code.alias("code"), F.coalesce(memo, F.lit("")).alias("memo")).select(
        "d", (F.weekday("d") + 1).alias("weekday"), "weekday_char", "code", (F.col("code") == "2").alias("is_holiday"), "memo"
    )


def jp_holidays(spark: SparkSession, paths, years: list[int] | None = None) -> DataFrame:
    """Shift-JIS holidays with unpadded dates; needs spark.sql.legacy.javaCharsets=true."""
    raw = _csv(spark, paths, JP_HEADER, encoding="windows-31j")
    out = raw.select(F.lit("jp").alias("country"), F.to_date(F.col(JP_HEADER[0]), "y/M/d").alias("d"), F.col(JP_HEADER[1]).alias("name"))
    return out.filter(F.year("d").isin(years)) if years else out


def sg_holidays(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Yearly holiday files; a row of another year, or with a wrong weekday name, stops the job when it is read."""
    out = None
    for year, path in paths.items():
        rows = _csv(spark, path, SG_HEADER).withColumn("d", F.to_date("date"))
        good = (F.year("d") == year) & (F.date_format("d", "EEEE") == F.col("day"))
        checked = F.when(good, F.col("holiday")).otherwise(F.raise_error(F.concat(F.lit(f"inconsistent row of {year}: "), F.coalesce("date", F.lit("NULL")))))
        part = rows.select(F.lit("sg").alias("country"), "d", checked.alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def holiday_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "data struct<datasetId:string,name:string,managedBy:string,lastUpdatedAt:string>"
    return spark.read.schema(schema).json(path, multiLine=True).select("data.*")


def holiday_documents(spark: SparkSession, path: str) -> DataFrame:
    """Published holiday documents {country, holidays[]}."""
    docs = spark.read.schema("country string, holidays array<struct<d:date,name:string>>").json(path, multiLine=True)
    return docs.select("country", F.inline("holidays"))


def closure_rules(spark: SparkSession, path: str, country: str) -> DataFrame:
    schema = "startMD string, endMD string, lawName string, lawNumber string, article string, sourceUrl string"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.lit(country).alias("country"), F.col("startMD").alias("start_md"), F.col("endMD").alias("end_md"))


def lunar_days(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(LUNAR_SCHEMA).csv(path, header=True, mode="FAILFAST").na.fill("", ["solar_term"])


def occasions(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(OCCASION_SCHEMA).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def lunar_segments(spark: SparkSession, path: str) -> DataFrame:
    """Month segments: start, year name, month label, leap flag, first day and length; tens of rows per year."""
    rows = spark.read.schema("start date, year_name string, month string, leap int, first_day int, days int").json(path)
    return rows.withColumn("month_label", F.concat(F.when(F.col("leap") == 1, "閏").otherwise(""), "month")).drop("month", "leap")


def snapshot(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One version of a table written by ``sinks.write_version``; the newest when none is named.

    Versions are whole numbers joined by dots or dashes, such as 2026-07 or 1.10, and compare number by number; any
    other version stops the job.
    """
    table = spark.read.parquet(path)
    if version is None:
        text = F.col("version").cast("string")
        named = F.when(text.rlike(r"^[0-9]+([.-][0-9]+)*$"), text).otherwise(F.raise_error(F.concat(F.lit("not a version: "), text)))
        version = table.select(named.alias("v")).distinct().agg(F.max_by("v", F.split("v", "[.-]").cast("array<int>"))).first()[0]
    return table.filter(F.col("version").cast("string") == F.lit(str(version))).drop("version")


def publishable_points(spark: SparkSession, path: str) -> DataFrame:
    """Published points without the rows the classifier would hold back."""
    from schedlake.operators.normalize import has_entries, publish_reason

    points = spark.read.parquet(path)
    return points.filter(publish_reason(has_entries("schedule", "recycling_schedule", "foodscraps_schedule")).isNull())
