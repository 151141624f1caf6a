"""Normalising raw schedule records to one schema. Everything except ``nest_schedules`` and the joins is row-local."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.text import clean, is_blank, note, strip
from schedlake.functions.times import char_days, clock, mask_days, weekday_bit

ENTRY = "struct<weekday:array<int>,arrive:string,depart:string>"
ENTRIES = f"array<{ENTRY}>"
NO_ENTRIES = f"cast(array() as {ENTRIES})"

# Text timetable lines and grid cells.
TIMETABLE_LINE = r"(?md)^(?:班表時間|星期([一二三四五六日,]+))：([0-9]{1,2}:[0-9]{2})$"
OTHER_LINE = r"(?mdU)^(?!(?:班表時間|星期[一二三四五六日,]+)：[0-9]{1,2}:[0-9]{2}$).*\S.*$"
BARE_TIME = r"^([01]?[0-9]|2[0-3]):([0-5][0-9])$"
CELL_TIME = r"[0-2]?[0-9]:[0-5][0-9]"
CELL_BOTH = rf"^({CELL_TIME})~({CELL_TIME})\n\(({CELL_TIME})~({CELL_TIME})\)$"
CELL_GARBAGE_ONLY = rf"^({CELL_TIME})~({CELL_TIME})\n\(無清運\)$"
CELL_NONE = r"^無清運$"
FLAG_SUFFIXES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
COLLECTION_TYPES = {"定點": "定點清運", "沿街": "沿街收運"}


# -- schedules -----------------------------------------------------------------


def merge_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with equal (arrive, depart) become one with their sorted weekdays; unknown days stay apart as [].

    Weekdays travel as a bit mask, so the map side combines a hot key's rows before the shuffle.
    """
    known = F.col("weekday").isNotNull()
    return (
        entries.groupBy(*keys, "arrive", "depart", known.alias("known"))
        .agg(F.bit_or(weekday_bit(F.col("weekday"))).alias("mask"))
        .select(*keys, mask_days(F.col("mask")).alias("weekday"), "arrive", "depart")
    )


def nest_schedules(points: DataFrame, entries: DataFrame, kinds: tuple[str, ...], id_col: str) -> DataFrame:
    """Points with one array of merged entries per kind: schedule, recycling_schedule, foodscraps_schedule.

    A point's arrays hold distinct (weekdays, arrive, depart), so their size is bounded by the clock, not by the rows.
    """
    names = dict(zip(kinds, ("schedule", "recycling_schedule", "foodscraps_schedule")))
    merged = merge_entries(entries, [id_col, "kind"])
    entry = F.struct("weekday", "arrive", "depart")
    arrays = merged.groupBy(id_col).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(n) for k, n in names.items()]
    )
    empty = F.expr(NO_ENTRIES)
    out = points.join(arrays, id_col, "left")
    return reduce(lambda df, n: df.withColumn(n, F.coalesce(F.col(n), empty)), names.values(), out)


def group_days(days: Column) -> Column:
    """Array of (weekday, arrive, depart) to entries merged by time and ordered by their weekday list; row-local."""
    times = F.array_distinct(F.transform(days, lambda x: F.struct(x["arrive"].alias("arrive"), x["depart"].alias("depart"))))
    entries = F.transform(
        times,
        lambda t: F.struct(
            F.transform(
                F.filter(days, lambda x: (x["arrive"] == t["arrive"]) & (x["depart"] == t["depart"])), lambda x: x["weekday"]
            ).alias("weekday"),
            t["arrive"].alias("arrive"),
            t["depart"].alias("depart"),
        ),
    )
    return F.sort_array(entries)


def wide_days(df: DataFrame, prefix: str, out: str, notes: str) -> DataFrame:
    """``{prefix}_d1..7_time_s/e`` to entries; a day with exactly one good side, or a bad one, becomes a note."""
    raw = F.array(
        *[
            F.struct(
                F.lit(i).alias("weekday"),
                F.coalesce(F.col(f"{prefix}_d{i}_time_s"), F.lit("")).alias("raw_s"),
                F.coalesce(F.col(f"{prefix}_d{i}_time_e"), F.lit("")).alias("raw_e"),
            )
            for i in range(1, 8)
        ]
    )
    read = lambda x: F.struct(
        x["weekday"].alias("weekday"), clock(x["raw_s"]).alias("arrive"), clock(x["raw_e"]).alias("depart"), x["raw_s"].alias("raw_s"), x["raw_e"].alias("raw_e")
    )
    good = lambda x: x["arrive"].isNotNull() & x["depart"].isNotNull()
    # kept as a column, so the regular expressions run once per cell
    df = df.withColumn("__cells", F.transform(raw, read))
    cells = F.col("__cells")
    bad = F.filter(cells, lambda x: ~good(x) & ((x["raw_s"] != "") | (x["raw_e"] != "")))
    text = lambda x: F.concat(
        F.lit(f"原始{prefix}_d"), x["weekday"].cast("string"), F.lit("時間格式異常:'"), x["raw_s"], F.lit("'/'"), x["raw_e"], F.lit("'")
    )
    return df.withColumn(out, group_days(F.filter(cells, good))).withColumn(notes, F.transform(bad, text)).drop("__cells")


def flag_days(df: DataFrame, prefix: str, time: Column, out: str, notes: str) -> DataFrame:
    """Seven Y flags and one time to at most one entry; other flag values are noted and ignored."""
    flags = F.array(
        *[
            F.struct(F.lit(i + 1).alias("weekday"), F.lit(f"{prefix}{s}").alias("name"), F.coalesce(F.col(f"{prefix}{s}"), F.lit("")).alias("flag"))
            for i, s in enumerate(FLAG_SUFFIXES)
        ]
    )
    days = F.transform(F.filter(flags, lambda x: x["flag"] == "Y"), lambda x: x["weekday"])
    entry = F.array(F.struct(days.alias("weekday"), time.alias("arrive"), F.lit(None).cast("string").alias("depart")))
    odd = F.filter(flags, lambda x: ~x["flag"].isin("Y", ""))
    return df.withColumn(out, F.when((F.size(days) > 0) & time.isNotNull(), entry).otherwise(F.expr(NO_ENTRIES))).withColumn(
        notes, F.transform(odd, lambda x: F.concat(x["name"], F.lit(" 未知格式已捨棄:'"), x["flag"], F.lit("'")))
    )


def parse_timetable(df: DataFrame, text: str, fallback: Column, name: str) -> DataFrame:
    """Text timetable to ``{name}_entries`` (weekday, arrive, depart, weekday_source) and ``{name}_drops``.

    Lines are found by regular expressions over the whole text, in line order; a line without
    weekday characters has an unknown day. A single unreadable line falls back to the bare
    arrival time, where that is a time; every other unreadable line is dropped with its reason.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    all_of = lambda pattern, group: F.regexp_extract_all(raw, F.lit(pattern), F.lit(group))
    df = df.withColumn("__times", all_of(TIMETABLE_LINE, 2)).withColumn("__chars", all_of(TIMETABLE_LINE, 1)).withColumn("__bad", all_of(OTHER_LINE, 0))

    def entry(days: Column, arrive: Column) -> Column:
        source = F.when(F.size(days) > 0, "listed").otherwise("absent")
        return F.struct(days.alias("weekday"), arrive.alias("arrive"), F.lit(None).cast("string").alias("depart"), source.alias("weekday_source"))

    rescued = (F.size("__times") == 0) & (F.size("__bad") == 1) & F.coalesce(fallback.rlike(BARE_TIME), F.lit(False))
    parsed = F.transform("__times", lambda t, i: entry(char_days(F.get("__chars", i)), t))
    why = F.concat(F.lit("格式異常但以 arrive_time 交叉檢查復原:'"), F.get("__bad", F.lit(0)), F.lit("' -> "), fallback)
    dropped = F.transform("__bad", lambda x: F.concat(F.lit("格式異常已捨棄:'"), x, F.lit("'")))
    return (
        df.withColumn(f"{name}_entries", F.when(rescued, F.array(entry(F.array().cast("array<int>"), fallback))).otherwise(parsed))
        .withColumn(f"{name}_drops", F.when(rescued, F.array(why)).otherwise(dropped))
        .drop("__times", "__chars", "__bad")
    )


def text_timetable(df: DataFrame, primary: str, memo: str, bare: str) -> DataFrame:
    """Adds entries (primary lines, then memo lines), drops, memo_entries and the arrival mismatch flag."""
    out = parse_timetable(parse_timetable(df, primary, F.col(bare), "__p"), memo, F.lit(None).cast("string"), "__m")
    out = out.withColumn("entries", F.concat("__p_entries", "__m_entries"))
    times = F.transform("entries", lambda x: x["arrive"])
    mismatch = F.coalesce(F.col(bare).rlike(BARE_TIME), F.lit(False)) & (F.size("entries") > 0) & ~F.array_contains(times, F.col(bare))
    return (
        out.withColumn("drops", F.concat("__p_drops", "__m_drops"))
        .withColumn("memo_entries", F.size("__m_entries"))
        .withColumn("mismatch", F.coalesce(mismatch, F.lit(False)))
        .drop("__p_entries", "__m_entries", "__p_drops", "__m_drops")
    )


def classify_cell(cell: Column) -> Column:
    """Timetable grid cell to (kind, garbage times, recycling times); kind is both, garbage_only, none or invalid."""
    c = strip(F.coalesce(cell, F.lit("")))
    null = F.lit(None).cast("string")
    part = lambda form, i: F.regexp_extract(c, form, i)

    def item(kind, g1, g2, r1, r2):
        return F.struct(F.lit(kind).alias("kind"), g1.alias("g_arrive"), g2.alias("g_depart"), r1.alias("r_arrive"), r2.alias("r_depart"))

    return (
        F.when(c.rlike(CELL_BOTH), item("both", *[part(CELL_BOTH, i) for i in (1, 2, 3, 4)]))
        .when(c.rlike(CELL_GARBAGE_ONLY), item("garbage_only", part(CELL_GARBAGE_ONLY, 1), part(CELL_GARBAGE_ONLY, 2), null, null))
        .when(c.rlike(CELL_NONE), item("none", null, null, null, null))
        .otherwise(item("invalid", null, null, null, null))
    )


def grid_rows(df: DataFrame, cells: str = "cells", header: str = "里別") -> DataFrame:
    """Rows of a timetable grid with their drop reason (NULL = usable). Header and blank rows are skipped.

    Ten cells, or eleven with a collection type in the fourth; the first failing test names the reason.
    """
    c = F.col(cells)
    first = strip(F.coalesce(F.get(c, F.lit(0)), F.lit("")))
    n = F.size(c)
    start = F.when(n == 11, 4).otherwise(3)
    parsed = F.transform(F.slice(c, start + 1, 7), lambda x: classify_cell(x))
    typed = clean(F.get(c, F.lit(3)))
    mapped = F.coalesce(*[F.when(typed == k, F.lit(v)) for k, v in COLLECTION_TYPES.items()])
    name = strip(F.regexp_replace(F.coalesce(F.get(c, F.lit(2)), F.lit("")), "\n", ""))
    reason = (
        F.when(~n.isin(10, 11), "wrong_col_count")
        .when(F.exists("parsed", lambda x: x["kind"] == "invalid"), "cell_pattern_fail")
        .when(F.col("point_name") == "", "empty_point_name")
        .when((n == 11) & mapped.isNull(), "unknown_collection_type")
    )

    def side(prefix):
        days = F.transform(
            F.col("parsed"),
            lambda x, i: F.struct((i + 1).alias("weekday"), x[f"{prefix}_arrive"].alias("arrive"), x[f"{prefix}_depart"].alias("depart")),
        )
        return group_days(F.filter(days, lambda x: x["arrive"].isNotNull()))

    return (
        df.filter((first != "") & (first != header))
        .withColumn("parsed", parsed)
        .withColumn("village", first)
        .withColumn("plate", clean(F.get(c, F.lit(1))))
        .withColumn("point_name", name)
        .withColumn("collection_type", F.when(n == 11, mapped).otherwise(F.lit(COLLECTION_TYPES["定點"])))
        .withColumn("drop_reason", reason)
        .withColumn("schedule", F.when(F.col("drop_reason").isNull(), side("g")))
        .withColumn("recycling_schedule", F.when(F.col("drop_reason").isNull(), side("r")))
        .withColumn("first_arrive", first_arrive(F.col("schedule")))
    )


def first_arrive(entries: Column, sort: bool = True) -> Column:
    """Arrival of the first entry by weekday list (or in the given order); NULL when there is none."""
    return F.get(F.sort_array(entries) if sort else entries, F.lit(0))["arrive"]


# -- records ------------------------------------------------------------------


def exclude_rows(df: DataFrame, code: str, codes: list[str], caption: str, keywords: list[str]) -> DataFrame:
    """Drops rows whose code is listed or whose caption contains a keyword; NULLs are kept."""
    in_codes = F.coalesce(F.col(code).isin(codes), F.lit(False))
    has_word = reduce(lambda a, b: a | b, [F.coalesce(F.col(caption).contains(k), F.lit(False)) for k in keywords])
    return df.filter(~in_codes & ~has_word)


def dim_map(df: DataFrame, dim: DataFrame, on: str, unmatched: str = "keep", fallback: dict[str, str] | None = None) -> DataFrame:
    """Looks ``on`` up in a dimension; unmatched rows get the fallback values, or go when ``unmatched='drop'``.

    Spark broadcasts the dimension when its measured size allows and shuffles otherwise.
    """
    out = df.join(dim, on, "inner" if unmatched == "drop" else "left")
    for name, value in (fallback or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def category(raw: Column, mapping: dict[str, str]) -> tuple[Column, Column]:
    """(category, note): an unmapped value is kept as it is and noted."""
    text = strip(F.coalesce(raw, F.lit("")))
    mapped = F.coalesce(*[F.when(text == k, F.lit(v)) for k, v in mapping.items()])
    return F.coalesce(mapped, F.nullif(text, F.lit(""))), note(mapped.isNull(), F.concat(F.lit("原始清運方式無法對應:'"), text, F.lit("'")))


def sanitize(entries: Column, required: bool) -> Column:
    """Entries for publishing: NULL weekdays become [], audit fields go. An empty optional array becomes NULL, a required one []."""
    cleaned = F.transform(
        entries,
        lambda e: F.struct(
            F.coalesce(e["weekday"], F.array().cast("array<int>")).alias("weekday"), e["arrive"].alias("arrive"), e["depart"].alias("depart")
        ),
    )
    if required:
        return F.coalesce(cleaned, F.expr(NO_ENTRIES))
    return F.when(F.size(entries) > 0, cleaned)


def publish_reason(has_any: Column, district: str = "district", name: str = "point_name") -> Column:
    """Why a row is not published (NULL = it is): missing district, missing name, no schedule at all; first reason wins."""
    return (
        F.when(is_blank(F.col(district)), "missing_district")
        .when(is_blank(F.col(name)), "missing_point_name")
        .when(~has_any, "empty_schedule_and_recycling")
    )


def has_entries(*arrays: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.size(F.col(a)) > 0, F.lit(False)) for a in arrays])


def parse_id(point_id: Column) -> tuple[Column, Column]:
    """(district slug, point slug) of PREFIX-DISTRICT-rest; both NULL when malformed."""
    parts = F.split(point_id, "-")
    rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    ok = (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) != "") & F.forall(rest, lambda s: s != "")
    return F.when(ok, F.lower(F.get(parts, F.lit(1)))), F.when(ok, F.array_join(rest, "-"))


def build_id(prefix: Column, district_slug: Column, point_slug: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.upper(district_slug), F.lit("-"), point_slug)


def is_legacy_slug(slug: Column) -> Column:
    return slug.rlike("^[0-9]+$")


def union_by_key(stops: DataFrame, keys: list[str], variant: str, preferred: str, other: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key from two query results: the last row (by ``order``) of each variant; common fields from the preferred one."""
    row = F.struct(*fields)
    last = lambda v: F.max_by(F.when(F.col(variant) == v, row), F.when(F.col(variant) == v, F.col(order)))
    grouped = stops.groupBy(*keys).agg(last(preferred).alias(preferred), last(other).alias(other))
    base = F.coalesce(F.col(preferred), F.col(other))
    return grouped.select(
        "*",
        *[base[f].alias(f) for f in fields],
        F.when(F.col(preferred).isNull(), f"{other}_only").when(F.col(other).isNull(), f"{preferred}_only").otherwise("both").alias("present"),
    )
