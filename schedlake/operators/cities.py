"""The four city sources normalised to one points table, and the steps from there to published points.

Every function returns the same columns: the identity columns (ord, district_slug, plate,
route_scope, first_arrive) and the point itself. Apart from the union of route stops they are
projections and small dimension joins, so they run at scan speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions import geo, text
from schedlake.functions.dates import roc_date
from schedlake.functions.times import clock
from schedlake.operators import normalize as N
from schedlake.operators.identity import assign_ids, base_key
from schedlake.operators.quality import TAGGED, whitelist

# Rows that are no collection points.
EXCLUDED_TYPES, EXCLUDED_WORDS = ["往廠"], ["焚化廠號"]

POINT = [
    "city", "district", "village", "point_name", "address", "lat", "lng", "schedule", "recycling_schedule", "foodscraps_schedule",
    "collection_type", "notes", "source", "fetched_at",
]
COLUMNS = ["ord", "district_slug", "plate", "route_scope", "first_arrive", *POINT]


def _tagged(entries: str):
    """Entries in the common form, without a weekday source."""
    return F.transform(entries, lambda e: F.struct(e["weekday"].alias("weekday"), e["arrive"].alias("arrive"), e["depart"].alias("depart"), F.lit(None).cast("string").alias("weekday_source")))


def _finish(df: DataFrame) -> DataFrame:
    for name in COLUMNS:
        if name not in df.columns:
            kind = TAGGED if name.endswith("schedule") else "double" if name in ("lat", "lng") else "string"
            df = df.withColumn(name, F.lit(None).cast(kind))
    for name in ("schedule", "recycling_schedule", "foodscraps_schedule"):
        fields = df.schema[name].dataType.elementType.names
        if "weekday_source" not in fields:
            df = df.withColumn(name, _tagged(name))
    return df.select(*COLUMNS)


def wide_day_city(raw: DataFrame, dims: DataFrame) -> DataFrame:
    """Daily start and end columns (see ``readers.WIDE_DAYS``), garbage and recycling."""
    rows = N.exclude_rows(raw, "task_type", EXCLUDED_TYPES, "caption", EXCLUDED_WORDS)
    rows = rows.withColumn("code", text.strip(F.coalesce("area", F.lit(""))))
    rows = N.dim_map(rows, dims, "code", fallback={"district_slug": "unknown"})
    rows = N.wide_days(N.wide_days(rows, "g", "schedule", "g_notes"), "r", "recycling_schedule", "r_notes")
    kind, kind_note = N.category(F.col("task_type"), N.COLLECTION_TYPES)
    rows = rows.withColumn("point_name", text.clean(F.col("caption"))).withColumn("plate", text.clean(F.col("car_licence")))
    plate_note = text.note(F.col("plate").isNotNull(), F.concat(F.lit("車牌"), "plate"))
    return _finish(
        rows.withColumn("city", F.col("env_city"))
        .withColumn("village", text.clean(F.col("village")))
        .withColumn("address", text.address(F.col("city"), F.col("district"), F.col("point_name")))
        .withColumn("collection_type", kind)
        .withColumn("notes", text.join_notes(plate_note, F.col("g_notes"), F.col("r_notes"), kind_note))
        .withColumn("first_arrive", N.first_arrive(F.col("schedule"), sort=False))
        .withColumn("source", F.col("env_source"))
        .withColumn("fetched_at", F.col("env_fetched_at"))
    )


def flag_day_city(raw: DataFrame, dims: DataFrame) -> DataFrame:
    """Weekday flags and one time (see ``readers.FLAG_DAYS``), three kinds; the source's city field is the district."""
    rows = raw.withColumn("code", text.strip(F.coalesce("city", F.lit("")))).drop("city")
    rows = N.dim_map(rows, dims, "code", fallback={"district_slug": "unknown"})
    rows = rows.withColumn("raw_time", text.strip(F.coalesce("time", F.lit("")))).withColumn("at", clock(F.col("raw_time")))
    kinds = (("garbage", "schedule"), ("recycling", "recycling_schedule"), ("foodscraps", "foodscraps_schedule"))
    for kind, name in kinds:
        rows = N.flag_days(rows, kind, F.col("at"), name, f"{kind}_notes")
    lat, lng, failed = geo.parse_coords(F.col("latitude"), F.col("longitude"))
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    memo = text.clean(F.col("memo"))
    notes = text.join_notes(
        text.note((F.col("raw_time") != "") & F.col("at").isNull(), F.concat(F.lit("原始 time 格式異常:"), quoted("raw_time"))),
        *[F.col(f"{kind}_notes") for kind, _ in kinds],
        text.note(failed, F.concat(F.lit("經緯度格式異常:"), shown("latitude"), F.lit("/"), shown("longitude"))),
        text.note(memo.isNotNull(), memo),
    )
    return _finish(
        rows.withColumn("city", F.col("env_city"))
        .withColumn("point_name", text.clean(F.col("name")))
        .withColumn("village", text.clean(F.col("village")))
        .withColumn("address", text.address(F.col("city"), F.col("district"), F.col("point_name")))
        .withColumn("lat", lat)
        .withColumn("lng", lng)
        .withColumn("notes", notes)
        .withColumn("route_scope", text.clean(F.col("lineid")))
        .withColumn("first_arrive", F.col("at"))
        .withColumn("source", F.col("env_source"))
        .withColumn("fetched_at", F.col("env_fetched_at"))
    )


def route_city(stops: DataFrame, routes: DataFrame, dims: DataFrame, city: str, source: str) -> DataFrame:
    """Route stops of two query types united per (route, poi); rows of unknown districts or without any time are left out.

    ``route_stops_united`` keeps them for the counters.
    """
    rows = route_stops_united(stops, routes, dims).filter("district is not null and (size(schedule) > 0 or size(coalesce(recycling_schedule, array())) > 0)")
    label = lambda c, word: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda d: F.concat(F.lit(word), d))
    return _finish(
        rows.withColumn("city", F.lit(city))
        .withColumn("point_name", text.clean(F.col("poi_name")))
        .withColumn("village", text.clean(F.col("show_memo")))
        .withColumn("address", text.address(F.col("city"), F.col("district"), F.col("point_name")))
        .withColumn("notes", text.join_notes(label("schedule_drops", "一般垃圾"), label("recycling_drops", "資源回收")))
        .withColumn("plate", F.concat_ws(":", "route_id", "poi_id"))
        .withColumn("route_scope", F.col("route_id"))
        .withColumn("first_arrive", N.first_arrive(F.col("schedule"), sort=False))
        .withColumn("source", F.lit(source))
    )


def route_stops_united(stops: DataFrame, routes: DataFrame, dims: DataFrame) -> DataFrame:
    """One row per (route, poi) with both parsed schedules, their drops and counters, the district (NULL when unknown) and the order of first appearance."""
    # places in reading order: each file starts after the last place of the one before; one row per file is ranked
    ends = stops.groupBy("file").agg((F.max("pos") + 1).cast("long").alias("places"))
    before = F.coalesce(F.sum("places").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = stops.join(ends.select("file", before.alias("start")), "file").withColumn("seen", F.col("start") + F.col("pos")).drop("start")
    fields = ["poi_name", "show_memo", "lat", "lng", "arrive_time", "show_arrive_time", "show_memo_time", "show_recycle_arrive_time", "show_recycle_memo_time"]
    united = N.union_by_key(numbered, ["route_id", "poi_id"], "car_type", "lagi", "recycle", "seen", fields)
    order = numbered.groupBy("route_id", "poi_id").agg(F.min("seen").alias("ord"), F.max("fetched_at").alias("fetched_at"))
    rows = united.drop(*fields[4:]).join(order, ["route_id", "poi_id"])
    for side, primary, memo, name in (
        ("lagi", "show_arrive_time", "show_memo_time", "schedule"),
        ("recycle", "show_recycle_arrive_time", "show_recycle_memo_time", "recycling"),
    ):
        parts = rows.withColumn("__a", F.col(f"{side}.{primary}")).withColumn("__b", F.col(f"{side}.{memo}")).withColumn("__c", F.col(f"{side}.arrive_time"))
        parsed = N.text_timetable(parts, "__a", "__b", "__c")
        present = F.col(side).isNotNull()
        rows = (
            parsed.withColumn(f"{name}_entries", F.when(present, F.col("entries")))
            .withColumn(f"{name}_drops", F.when(present, F.col("drops")))
            .withColumn(f"{name}_memo", F.when(present, F.col("memo_entries")))
            .withColumn(f"{name}_mismatch", F.when(present, F.col("mismatch").cast("int")).otherwise(0))
            .drop("__a", "__b", "__c", "entries", "drops", "memo_entries", "mismatch")
        )
    where = routes.select(F.col("routing_id").alias("route_id"), F.col("district_gid").alias("code")).join(dims, "code", "left").drop("code")
    rows = rows.join(where, "route_id", "left").withColumn("schedule", F.coalesce("schedule_entries", F.array().cast(TAGGED)))
    recycling = F.when(F.size("recycling_entries") > 0, F.col("recycling_entries"))
    return rows.withColumn("recycling_schedule", recycling).withColumn("mismatches", F.col("schedule_mismatch") + F.col("recycling_mismatch")).drop("lagi", "recycle")


def grid_city(cells: DataFrame, dims: DataFrame, city: str, source: str) -> DataFrame:
    """Timetable grids (ord, district, download_text, cells): usable rows only; ``normalize.grid_rows`` keeps the others with their reason."""
    rows = N.grid_rows(cells).filter("drop_reason is null")
    rows = rows.withColumn("code", F.col("district")).drop("district")
    rows = N.dim_map(rows, dims, "code", unmatched="drop")
    day = roc_date(F.col("download_text"))
    return _finish(
        rows.withColumn("city", F.lit(city))
        .withColumn("address", F.concat("city", "district", "point_name"))
        .withColumn("notes", F.concat(F.lit("車牌"), "plate"))
        .withColumn("source", F.lit(source))
        .withColumn("fetched_at", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00+08:00")))
    )


def identify(points: DataFrame, slots: DataFrame, city_slug: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(points with point_id and city_slug, new id map) for one city; ``slots`` is the stored map."""
    keyed = (
        points.withColumn("city_slug", F.lit(city_slug)).withColumn("base_key", base_key(F.col("village"), F.col("point_name"))).withColumn("prefix", F.lit(prefix))
    )
    rows = keyed.select("ord", "city_slug", "district_slug", "base_key", "plate", "route_scope", "first_arrive", "prefix")
    assigned, id_map = assign_ids(rows, slots)
    out = keyed.join(assigned.select("ord", "point_id"), "ord").select("ord", "point_id", "city_slug", "district_slug", *POINT)
    return out, id_map


def calendar_violations(days: DataFrame, weekdays: list[str], codes: list[str], memos: list[str]) -> DataFrame:
    """Values of a calendar file outside the allowed sets: (column, value, n)."""
    spark = days.sparkSession
    parts = []
    for column, allowed in (("weekday_char", weekdays), ("code", codes), ("memo", memos)):
        listed = spark.createDataFrame([(a,) for a in allowed], "value string")
        parts.append(whitelist(days, column, listed).select(F.lit(column).alias("column"), "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
