"""Domain-shaped views over the test tables, built with the DataFrame API.

``oracle_views.py`` holds the same views as DuckDB SQL for the parity check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.dates import iso_weekday, lunar_day_label, lunar_month_label
from schedlake.operators.normalize import nest_schedules

KINDS = ("garbage", "recycling", "foodscraps")


class Views:
    """The test tables of one directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for work that is heavy per row, dealt to all cores by key. Columns and filters are still pushed below the exchange."""
        return self.table(name).repartition(self.spark.sparkContext.defaultParallelism, key)

    # -- points and schedules -------------------------------------------------

    def points(self) -> DataFrame:
        """Points of the customers. Two districts in different cities share the slug ``nation0``."""
        customer, nation, region = (self.table(t) for t in ("customer", "nation", "region"))
        joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            region, F.col("n_regionkey") == F.col("r_regionkey")
        )
        slug = "CASE WHEN n_nationkey = 1 THEN 'nation0' ELSE lower(replace(n_name, '_', '')) END"
        return joined.selectExpr(
            "c_custkey AS ord",
            "lower(replace(r_name, ' ', '')) AS city_slug",
            "r_name AS city",
            "n_name AS district",
            f"{slug} AS district_slug",
            "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('V', CAST(c_custkey % 4 AS STRING)) END AS village",
            "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE concat('Road ', CAST(c_custkey % 6 AS STRING)) END AS point_name",
            "concat('PL', CAST(c_custkey % 5 AS STRING)) AS plate",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN CAST(10 AS DOUBLE)"
            " ELSE 21.5D + CAST((c_custkey * 37) % 400 AS DOUBLE) / 100 END AS lat",
            "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 119.5D + CAST((c_custkey * 53) % 300 AS DOUBLE) / 100 END AS lng",
            "CASE WHEN c_custkey % 2 = 0 THEN 'FIXED' WHEN c_custkey % 3 = 0 THEN 'PASS' ELSE NULL END AS collection_type",
            f"concat(upper(substr(r_name, 1, 3)), '-', upper({slug}), '-', CAST(c_custkey AS STRING)) AS point_id",
            "CASE WHEN c_custkey % 3 = 0 THEN concat('2026-07-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'))"
            " ELSE concat('2026-07-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), 'T11:50:16.537798+08:00') END AS fetched_at",
        )

    def entries(self) -> DataFrame:
        """Long-form entries; a NULL weekday means the day is unknown."""
        return self.table("orders").selectExpr(
            "o_custkey AS ord",
            "o_orderkey AS seq",
            "CASE o_orderstatus WHEN 'O' THEN 'garbage' WHEN 'F' THEN 'recycling' ELSE 'foodscraps' END AS kind",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 7 + 1 AS INT) END AS weekday",
            "concat(lpad(CAST((o_orderkey * 7) % 24 AS STRING), 2, '0'), ':', lpad(CAST((o_orderkey * 11) % 60 AS STRING), 2, '0')) AS arrive",
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(lpad(CAST((o_orderkey * 7) % 24 AS STRING), 2, '0'), ':59') END AS depart",
        )

    def points_nested(self) -> DataFrame:
        """Points with their three schedule arrays."""
        return nest_schedules(self.points(), self.entries(), KINDS, id_col="ord")

    # -- calendars --------------------------------------------------------------

    def calendar(self, gaps: bool = False) -> DataFrame:
        days = self.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
        named = (F.month("d") * 31 + F.day("d")) % 29 == 0
        out = days.select(
            "d",
            iso_weekday(F.col("d")).alias("weekday"),
            ((iso_weekday(F.col("d")) >= 6) | named).alias("is_holiday"),
            F.when(named, F.concat(F.lit("H"), F.month("d").cast("string"))).otherwise("").alias("memo"),
        )
        if gaps:
            out = out.filter(~((F.month("d") % 3 == 0) & F.day("d").between(8, 12) & ~F.col("is_holiday")))
        return out

    def foreign(self) -> DataFrame:
        """Holidays abroad. All lines count: a name is a holiday on a day if its order keys add up to a multiple of 23,
        which makes about one day in four a holiday of a country."""
        lines = self.table("lineitem").selectExpr(
            "CASE WHEN l_suppkey % 2 = 0 THEN 'jp' ELSE 'sg' END AS country",
            "CAST(l_shipdate AS DATE) AS d",
            "concat('F', CAST(l_linenumber AS STRING)) AS name",
            "l_orderkey",
        )
        return lines.groupBy("country", "d", "name").agg(F.sum("l_orderkey").alias("s")).filter("s % 23 = 0").drop("s")

    def closure_rule(self) -> DataFrame:
        """One closure window per country that has holidays."""
        return self.foreign().groupBy("country").agg(F.lit("12-29").alias("start_md"), F.lit("01-03").alias("end_md")).filter("country = 'jp'")

    def asof_dates(self) -> DataFrame:
        """Query dates, one row per shipped line."""
        return self.table("lineitem").select(F.to_date("l_shipdate").alias("as_of"), "l_orderkey", "l_linenumber")

    # -- lunar dimension --------------------------------------------------------

    def lunar_days(self) -> DataFrame:
        """Daily lunar dimension over the order dates: months of 30 and 29 days, 37 months per three years."""
        span = self.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
        days = span.select(F.explode(F.sequence("lo", "hi")).alias("solar_date"), F.col("lo"))
        rest = F.datediff("solar_date", "lo") % 59
        month_no = 10 + 2 * F.floor(F.datediff("solar_date", "lo") / 59) + F.when(rest < 30, 0).otherwise(1)
        q = F.col("month_no") % 37
        year_in_cycle = F.least(F.floor(q / 12), F.lit(2))
        pos = q - 12 * year_in_cycle
        leap = (year_in_cycle == 2) & (pos == 6)
        month = F.when((year_in_cycle == 2) & (pos >= 6), pos).otherwise(pos + 1)
        stems = F.array(*[F.lit(s) for s in "甲乙丙丁戊己庚辛壬癸"])
        branches = F.array(*[F.lit(s) for s in "子丑寅卯辰巳午未申酉戌亥"])
        zodiacs = F.array(*[F.lit(s) for s in "鼠牛虎兔龍蛇馬羊猴雞狗豬"])
        terms = F.array(*[F.lit(t) for t in SOLAR_TERMS])
        doy = F.dayofyear("solar_date")
        return (
            days.withColumn("month_no", month_no.cast("int"))
            .withColumn("lunar_day", F.when(rest < 30, rest + 1).otherwise(rest - 29).cast("int"))
            .withColumn("lunar_year", (1994 + 3 * F.floor(F.col("month_no") / 37) + year_in_cycle).cast("int"))
            .withColumn("lunar_month", month.cast("int"))
            .withColumn("is_leap_month", leap)
            .select(
                "solar_date",
                "lunar_year",
                "lunar_month",
                "lunar_day",
                "is_leap_month",
                lunar_month_label(F.col("lunar_month"), F.col("is_leap_month")).alias("lunar_month_label"),
                lunar_day_label(F.col("lunar_day")).alias("lunar_day_label"),
                F.concat(F.get(stems, (F.col("lunar_year") - 4) % 10), F.get(branches, (F.col("lunar_year") - 4) % 12)).alias("ganzhi"),
                F.get(zodiacs, (F.col("lunar_year") - 4) % 12).alias("zodiac"),
                F.when(((doy - 5) % 15 == 0) & doy.between(5, 350), F.get(terms, ((doy - 5) / 15).cast("int"))).otherwise("").alias("solar_term"),
            )
        )

    def occasions(self) -> DataFrame:
        """Anniversaries, one per part, spread over the lunar months and days (day 30 included)."""
        return self.table("part").selectExpr(
            "p_partkey AS ord",
            "p_brand AS deity_name",
            "concat(p_brand, ' ', p_type) AS common_name",
            "CAST(p_partkey % 12 + 1 AS INT) AS lunar_month",
            "CAST((p_partkey * 7) % 30 + 1 AS INT) AS lunar_day",
            "p_type AS occasion_type",
            "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS honorific_source",
        )

    # -- routes -------------------------------------------------------------------

    def routes(self) -> DataFrame:
        """Points on routes: the pairs that occur among the lines."""
        part, supplier = self.table("part"), self.table("supplier")
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        joined = pairs.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.selectExpr(
            "p_partkey AS poi_id",
            "s_suppkey AS route_id",
            "CASE WHEN (p_partkey + s_suppkey) % 3 = 0 THEN 'lagi' ELSE 'recycle' END AS car_type",
            "p_name AS poi_name",
            "s_nationkey AS district_gid",
        )

    def stops(self) -> DataFrame:
        """Text timetables of route stops: one stop per (order, part) line, both car types."""
        return self.spread("lineitem", "l_suppkey").selectExpr(
            "l_orderkey",
            "l_linenumber",
            "l_suppkey AS route_id",
            "l_partkey AS poi_id",
            "CASE WHEN l_linenumber % 2 = 1 THEN 'lagi' ELSE 'recycle' END AS car_type",
            "concat(CAST(l_orderkey % 24 AS STRING), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0')) AS bare",
            "CASE WHEN l_orderkey % 5 = 0 THEN concat('班表時間：', CAST(l_orderkey % 24 AS STRING), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'))"
            " WHEN l_orderkey % 5 = 1 THEN concat('星期一,四：', CAST(l_orderkey % 24 AS STRING), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'),"
            " '\n', '星期二,五,六：', lpad(CAST(l_suppkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'))"
            " WHEN l_orderkey % 5 = 2 THEN concat('星期三：', CAST(l_orderkey % 24 AS STRING), ':', CAST(100 + l_partkey % 60 AS STRING))"
            " WHEN l_orderkey % 5 = 3 THEN concat('星期日：', CAST(l_orderkey % 24 AS STRING), ';30', '\n', '星期六：08:15')"
            " ELSE '' END AS show_time",
            "CASE WHEN l_suppkey % 4 = 0 THEN '星期三：21:05' WHEN l_suppkey % 4 = 1 THEN '停駛' ELSE '' END AS memo_time",
        )


# The 24 solar terms, from early January.
SOLAR_TERMS = [
    "小寒", "大寒", "立春", "雨水", "驚蟄", "春分", "清明", "穀雨",
    "立夏", "小滿", "芒種", "夏至", "小暑", "大暑", "立秋", "處暑",
    "白露", "秋分", "寒露", "霜降", "立冬", "小雪", "大雪", "冬至",
]
