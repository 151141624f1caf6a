"""Queries of the normalising operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions import dates, geo, text, times
from schedlake.oracle_views import WEEKDAY_SQL
from schedlake.operators import normalize as N
from schedlake.plans.registry import query


def entries_text(c):
    """Entries as one comparable string: days@arrive-depart|..."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(
        F.transform(
            c, lambda e: F.concat(F.array_join(e["weekday"].cast("array<string>"), ","), F.lit("@"), e["arrive"], F.lit("-"), F.coalesce(e["depart"], F.lit("")))
        ),
        "|",
    )


MERGED_TEXT = "string_agg(array_to_string(days, ',') || '@' || arrive || '-' || coalesce(depart, ''), '|' ORDER BY days, arrive, depart NULLS FIRST)"


@query("exclude_rows", sql="""
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_mktsegment <> 'MACHINERY' AND NOT contains(c_name, '77')""")
def exclude_rows(v):
    return N.exclude_rows(v.table("customer"), "c_mktsegment", ["MACHINERY"], "c_name", ["77"]).select("c_custkey", "c_mktsegment")


@query("dim_map", "v_points", sql="""
SELECT ord, coalesce(d.name, 'unknown') AS district_name, coalesce(d.slug, 'unknown') AS slug
FROM v_points p LEFT JOIN (SELECT n_name AS district, lower(n_name) AS name, concat('d', CAST(n_nationkey AS VARCHAR)) AS slug FROM nation WHERE n_nationkey % 4 <> 0) d
ON p.district = d.district""")
def dim_map(v):
    dim = v.table("nation").filter("n_nationkey % 4 <> 0").select(
        F.col("n_name").alias("district"), F.lower("n_name").alias("district_name"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("slug")
    )
    out = N.dim_map(v.points(), dim, "district", fallback={"district_name": "unknown", "slug": "unknown"})
    return out.select("ord", "district_name", "slug")


@query("dim_map_drop", "v_points", sql="""
SELECT ord, slug FROM v_points p JOIN (SELECT n_name AS district, concat('d', CAST(n_nationkey AS VARCHAR)) AS slug FROM nation WHERE n_nationkey % 4 <> 0) d
ON p.district = d.district""")
def dim_map_drop(v):
    dim = v.table("nation").filter("n_nationkey % 4 <> 0").select(F.col("n_name").alias("district"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("slug"))
    return N.dim_map(v.points(), dim, "district", unmatched="drop").select("ord", "slug")


@query("clean_text", "v_points", sql="""
SELECT ord, village AS village_clean, point_name AS name_clean, city || district || point_name AS address FROM v_points""")
def clean_text(v):
    p = v.points().select(
        "ord", "city", "district",
        F.concat(F.lit(" "), F.coalesce("village", F.lit("")), F.lit("　")).alias("village"),
        F.concat(F.lit("\t"), F.coalesce("point_name", F.lit(" ")), F.lit(" ")).alias("point_name"),
    )
    name = text.clean(F.col("point_name"))
    return p.select("ord", text.clean(F.col("village")).alias("village_clean"), name.alias("name_clean"), text.address(F.col("city"), F.col("district"), name).alias("address"))


@query("category_map", "v_points", sql="""
SELECT ord, CASE collection_type WHEN 'FIXED' THEN '定點清運' ELSE collection_type END AS category,
  CASE WHEN collection_type = 'FIXED' THEN NULL ELSE '原始清運方式無法對應:''' || coalesce(collection_type, '') || '''' END AS note
FROM v_points""")
def category_map(v):
    kind, notes = N.category(F.col("collection_type"), {"FIXED": "定點清運"})
    return v.points().select("ord", kind.alias("category"), text.join_notes(notes).alias("note"))


@query("notes", "v_points", sql="""
SELECT ord, nullif(concat_ws('、', CASE WHEN plate IS NOT NULL THEN '車牌' || plate END, CASE WHEN lat IS NULL THEN 'no-geo' END, CASE WHEN village IS NULL THEN 'no-village' END), '') AS notes
FROM v_points""")
def notes(v):
    return v.points().select(
        "ord",
        text.join_notes(
            text.note(F.col("plate").isNotNull(), F.concat(F.lit("車牌"), "plate")),
            text.note(F.col("lat").isNull(), F.lit("no-geo")),
            text.note(F.col("village").isNull(), F.lit("no-village")),
        ).alias("notes"),
    )


@query("first_arrive", "v_points v_merged", sql="""
SELECT ord, (SELECT arrive FROM v_merged m WHERE m.ord = p.ord AND kind = 'garbage' ORDER BY days, arrive, depart NULLS FIRST LIMIT 1) AS first_arrive
FROM v_points p""")
def first_arrive(v):
    return v.points_nested().select("ord", N.first_arrive(F.col("schedule")).alias("first_arrive"))


def coord_text(key: str, a: int, mod: int, base: str) -> str:
    return (
        f"CASE WHEN {key} % 13 = 0 THEN '' WHEN {key} % {mod} = 0 THEN 'x9' ELSE concat('{base}.', CAST(({key} * {a}) % 100 + 100 AS {{s}})) END"
    )


LAT_TEXT, LNG_TEXT = coord_text("c_custkey", 37, 17, "23"), coord_text("c_custkey", 53, 19, "120")


@query("parse_coords", sql=f"""
SELECT c_custkey, try_cast(nullif(la, '') AS DOUBLE) AS lat,
  CASE WHEN la <> '' AND try_cast(la AS DOUBLE) IS NULL THEN NULL ELSE try_cast(nullif(lo, '') AS DOUBLE) END AS lng,
  ((la <> '' AND try_cast(la AS DOUBLE) IS NULL) OR (lo <> '' AND try_cast(lo AS DOUBLE) IS NULL)) AS failed
FROM (SELECT c_custkey, {LAT_TEXT.format(s='VARCHAR')} AS la, {LNG_TEXT.format(s='VARCHAR')} AS lo FROM customer)""")
def parse_coords(v):
    raw = v.table("customer").selectExpr("c_custkey", f"{LAT_TEXT.format(s='STRING')} AS la", f"{LNG_TEXT.format(s='STRING')} AS lo")
    lat, lng, failed = geo.parse_coords(F.col("la"), F.col("lo"))
    return raw.select("c_custkey", lat.alias("lat"), lng.alias("lng"), failed.alias("failed"))


@query("valid_geo", "v_points", sql="""
SELECT ord, coalesce(lat BETWEEN 21.5 AND 25.5 AND lng BETWEEN 119.5 AND 122.5, FALSE) AS valid FROM v_points""")
def valid_geo(v):
    return v.points().select("ord", geo.valid_geo(F.col("lat"), F.col("lng")).alias("valid"))


TOKEN = "concat(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE '' END, CAST(o_orderkey % 27 AS {s}), CASE WHEN o_orderkey % 4 = 0 THEN '：' ELSE ':' END, lpad(CAST(o_orderkey % 63 AS {s}), 2, '0'))"


@query("time_token", sql=f"""
SELECT o_orderkey, CASE WHEN ok THEN lpad(split_part(t, ':', 1), 2, '0') || ':' || split_part(t, ':', 2) END AS token,
  CASE WHEN ok THEN CAST(CAST(split_part(t, ':', 1) AS INT) * 60 + CAST(split_part(t, ':', 2) AS INT) AS INT) END AS minutes
FROM (SELECT o_orderkey, t, regexp_matches(t, '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') AS ok FROM
 (SELECT o_orderkey, replace(trim({TOKEN.format(s='VARCHAR')}), '：', ':') AS t FROM orders))""")
def time_token(v):
    t = v.table("orders").selectExpr("o_orderkey", f"{TOKEN.format(s='STRING')} AS t")
    return t.select("o_orderkey", times.clock(F.col("t")).alias("token")).withColumn("minutes", times.minutes(F.col("token")))


def wide_cell(i: int, side: str) -> str:
    """Raw time of weekday i: blank, bad or a time shared by several days."""
    minute = "05" if side == "s" else "35"
    blank = 11 if side == "s" else 13
    return (
        f"CASE WHEN (c_custkey + {i}) % 4 = 0 THEN '' WHEN (c_custkey + {i}) % {blank} = 0 THEN '' WHEN (c_custkey * {i}) % 29 = 0 THEN '9;30'"
        f" ELSE concat(CAST((c_custkey + {i} % 2) % 24 AS {{s}}), ':{minute}') END"
    )


WIDE_SQL = " UNION ALL ".join(
    f"SELECT c_custkey, {i} AS wd, {wide_cell(i, 's').format(s='VARCHAR')} AS s, {wide_cell(i, 'e').format(s='VARCHAR')} AS e FROM customer" for i in range(1, 8)
)


@query("wide_days", sql=f"""
WITH w AS ({WIDE_SQL}),
t AS (SELECT *, CASE WHEN regexp_matches(s, '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') THEN lpad(s, 5, '0') END AS a,
  CASE WHEN regexp_matches(e, '^([01]?[0-9]|2[0-3]):[0-5][0-9]$') THEN lpad(e, 5, '0') END AS d FROM w),
g AS (SELECT c_custkey, a, d, list_sort(list(wd)) AS days FROM t WHERE a IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT c_custkey, string_agg(concat('原始g_d', CAST(wd AS VARCHAR), '時間格式異常:''', s, '''/''', e, ''''), '、' ORDER BY wd) AS notes
  FROM t WHERE (a IS NULL OR d IS NULL) AND (s <> '' OR e <> '') GROUP BY 1)
SELECT c.c_custkey, coalesce(string_agg(array_to_string(days, ',') || '@' || a || '-' || d, '|' ORDER BY days), '') AS schedule, any_value(n.notes) AS notes
FROM customer c LEFT JOIN g ON g.c_custkey = c.c_custkey LEFT JOIN n ON n.c_custkey = c.c_custkey GROUP BY 1""")
def wide_days(v):
    raw = v.table("customer").selectExpr(
        "c_custkey", *[f"{wide_cell(i, x).format(s='STRING')} AS g_d{i}_time_{x}" for i in range(1, 8) for x in "se"]
    )
    out = N.wide_days(raw, "g", "schedule", "bad")
    return out.select("c_custkey", entries_text("schedule").alias("schedule"), text.join_notes(F.col("bad")).alias("notes"))


def flag_cell(i: int) -> str:
    return f"CASE WHEN (c_custkey * {i}) % 41 = 0 THEN 'N' WHEN (c_custkey + {i}) % 3 = 0 THEN 'Y' ELSE '' END"


FLAG_SQL = " UNION ALL ".join(f"SELECT c_custkey, {i} AS wd, '{s}' AS nm, {flag_cell(i)} AS f FROM customer" for i, s in enumerate(N.FLAG_SUFFIXES, 1))


@query("flag_days", sql=f"""
WITH f AS ({FLAG_SQL})
SELECT c_custkey, CASE WHEN count(*) FILTER (WHERE f = 'Y') > 0 AND c_custkey % 9 <> 0
   THEN string_agg(CAST(wd AS VARCHAR), ',' ORDER BY wd) FILTER (WHERE f = 'Y') || '@18:05-' ELSE '' END AS schedule,
  string_agg('garbage' || nm || ' 未知格式已捨棄:''N''', '、' ORDER BY wd) FILTER (WHERE f = 'N') AS notes
FROM f GROUP BY c_custkey""")
def flag_days(v):
    raw = v.table("customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '18:5' END AS raw_time", *[f"{flag_cell(i)} AS garbage{s}" for i, s in enumerate(N.FLAG_SUFFIXES, 1)]
    )
    time = times.clock(F.regexp_replace("raw_time", ":5$", ":05"))
    out = N.flag_days(raw, "garbage", time, "schedule", "odd")
    return out.select("c_custkey", entries_text("schedule").alias("schedule"), text.join_notes(F.col("odd")).alias("notes"))


@query("text_timetable", "v_stops", sql=f"""
WITH st AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM v_stops),
l AS (
  SELECT rid, poi_id, bare, 1 AS src, u.i, u.line, len(string_split(show_time, chr(10))) AS n FROM st,
    LATERAL (SELECT unnest(string_split(show_time, chr(10))) AS line, generate_subscripts(string_split(show_time, chr(10)), 1) AS i) u WHERE show_time <> ''
  UNION ALL
  SELECT rid, poi_id, bare, 2, u.i, u.line, 99 FROM st,
    LATERAL (SELECT unnest(string_split(memo_time, chr(10))) AS line, generate_subscripts(string_split(memo_time, chr(10)), 1) AS i) u WHERE memo_time <> ''),
p AS (SELECT *, regexp_extract(line, '^班表時間：([0-9]{{1,2}}:[0-9]{{2}})$', 1) AS t0, regexp_extract(line, '^星期([一二三四五六日,]+)：([0-9]{{1,2}}:[0-9]{{2}})$', 2) AS t1,
   regexp_extract(line, '^星期([一二三四五六日,]+)：([0-9]{{1,2}}:[0-9]{{2}})$', 1) AS chars FROM l),
e AS (SELECT *, CASE WHEN t0 <> '' THEN t0 WHEN t1 <> '' THEN t1 WHEN n = 1 THEN bare END AS arrive, (t0 = '' AND t1 = '') AS odd,
  CASE WHEN t1 <> '' THEN array_to_string(list_sort([list_position({WEEKDAY_SQL}, c) FOR c IN string_split(chars, ',')]), ',') ELSE '' END AS days FROM p),
g AS (SELECT rid, string_agg(days || '@' || arrive || '-', '|' ORDER BY src, i) FILTER (WHERE arrive IS NOT NULL) AS entries,
  count(*) FILTER (WHERE odd) AS n_drops, count(*) FILTER (WHERE src = 2 AND arrive IS NOT NULL) AS memo_entries,
  count(*) FILTER (WHERE arrive IS NOT NULL) > 0 AND NOT bool_or(coalesce(arrive = bare, FALSE)) AS mismatch
  FROM e GROUP BY 1)
SELECT coalesce(entries, '') AS entries, coalesce(n_drops, 0) AS n_drops, coalesce(memo_entries, 0) AS memo_entries, coalesce(mismatch, FALSE) AS mismatch,
  count(*) AS stops, count(DISTINCT s.poi_id) AS pois
FROM st s LEFT JOIN g ON g.rid = s.rid GROUP BY 1, 2, 3, 4""")
def text_timetable(v):
    out = N.text_timetable(v.stops(), "show_time", "memo_time", "bare")
    return (
        out.select(entries_text("entries").alias("entries"), F.size("drops").cast("long").alias("n_drops"), F.col("memo_entries").cast("long").alias("memo_entries"), "mismatch", "poi_id")
        .groupBy("entries", "n_drops", "memo_entries", "mismatch")
        .agg(F.count(F.lit(1)).alias("stops"), F.countDistinct("poi_id").alias("pois"))
    )


RUN_MASK = "CASE WHEN o_orderkey % 9 = 0 THEN '022' ELSE translate(lpad(CAST(o_orderkey * 9301 % 9999991 AS {s}), 7, '0'), '13579', '20222') END"


@query("mask_days", sql=f"""
SELECT o_orderkey, CASE WHEN length(m) <> 7 THEN '' ELSE array_to_string(list_sort([CASE WHEN i = 0 THEN 7 ELSE i END FOR i IN range(0, 7) IF substr(m, CAST(i + 1 AS INT), 1) = '2']), ',') END AS days
FROM (SELECT o_orderkey, {RUN_MASK.format(s='VARCHAR')} AS m FROM orders)""")
def mask_days(v):
    raw = v.table("orders").selectExpr("o_orderkey", f"{RUN_MASK.format(s='STRING')} AS m")
    return raw.select("o_orderkey", F.array_join(times.run_mask_days(F.col("m")).cast("array<string>"), ",").alias("days"))


def grid_cell(i: str) -> str:
    hh = f"lpad(CAST((c_custkey + {i} % 3) % 24 AS {{s}}), 2, '0')"
    return (
        f"CASE WHEN (c_custkey * 7 + {i}) % 61 = 0 THEN '18:00-19:00' WHEN (c_custkey + {i}) % 5 = 0 THEN concat({hh}, ':00~', {hh}, ':20', {{nl}}, '(', {hh}, ':05~', {hh}, ':25)')"
        f" WHEN (c_custkey + {i}) % 5 = 1 THEN concat({hh}, ':10~', {hh}, ':20', {{nl}}, '(無清運)') ELSE '無清運' END"
    )


GRID_HEAD = {
    "village": "CASE WHEN c_custkey % 53 = 0 THEN '里別' WHEN c_custkey % 59 = 0 THEN ' ' ELSE concat('V', CAST(c_custkey % 4 AS {s})) END",
    "plate": "concat('PL', CAST(c_custkey % 5 AS {s}))",
    "name": "CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE concat('Road ', CAST(c_custkey % 6 AS {s})) END",
    "ctype": "CASE WHEN c_custkey % 2 = 0 THEN '定點' WHEN c_custkey % 7 = 0 THEN '其他' ELSE '沿街' END",
    "width": "CASE WHEN c_custkey % 23 = 0 THEN 9 WHEN c_custkey % 3 = 0 THEN 11 ELSE 10 END",
}


def grid_sql() -> str:
    heads = ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in GRID_HEAD.items())
    cells = ", ".join(f"{grid_cell(str(i)).format(s='VARCHAR', nl='chr(10)')} AS c{i}" for i in range(1, 8))
    return f"c_custkey, c_nationkey, {heads}, {cells}"


def grid_binding(v):
    """A table of extracted cells: 9 (wrong), 10 or 11 per row."""
    raw = v.table("customer").selectExpr(
        "c_custkey",
        "c_nationkey AS district",
        *[f"{e.format(s='STRING')} AS {n}" for n, e in GRID_HEAD.items()],
        f"transform(sequence(1, 7), i -> {grid_cell('i').format(s='STRING', nl=chr(39) + chr(92) + 'n' + chr(39))}) AS days",
    )
    head = F.array("village", "plate", "name")
    cells = F.when(F.col("width") == 11, F.concat(head, F.array("ctype"), "days")).when(F.col("width") == 10, F.concat(head, "days")).otherwise(F.slice(F.concat(head, "days"), 1, 9))
    return raw.select("c_custkey", "district", cells.alias("cells"))


GRID_CTE = f"""
WITH raw AS (SELECT {grid_sql()} FROM customer),
days AS (SELECT c_custkey, u.i, u.c FROM raw, LATERAL (SELECT unnest([c1, c2, c3, c4, c5, c6, c7]) AS c, generate_subscripts([c1, c2, c3, c4, c5, c6, c7], 1) AS i) u),
cls AS (SELECT c_custkey, i, c, CASE WHEN regexp_matches(c, '^[0-2]?[0-9]:[0-5][0-9]~[0-2]?[0-9]:[0-5][0-9]\\n\\([0-2]?[0-9]:[0-5][0-9]~[0-2]?[0-9]:[0-5][0-9]\\)$') THEN 'both'
  WHEN regexp_matches(c, '^[0-2]?[0-9]:[0-5][0-9]~[0-2]?[0-9]:[0-5][0-9]\\n\\(無清運\\)$') THEN 'garbage_only' WHEN c = '無清運' THEN 'none' ELSE 'invalid' END AS kind FROM days),
bad AS (SELECT c_custkey, bool_or(kind = 'invalid') AS bad FROM cls GROUP BY 1),
rows_ AS (SELECT r.*, CASE WHEN width = 9 THEN 'wrong_col_count' WHEN bad THEN 'cell_pattern_fail' WHEN trim(name) = '' THEN 'empty_point_name'
  WHEN width = 11 AND ctype = '其他' THEN 'unknown_collection_type' END AS drop_reason FROM raw r JOIN bad USING (c_custkey) WHERE trim(village) <> '' AND village <> '里別')
"""


@query("cell_classify", sql=GRID_CTE + """,
g AS (SELECT c_custkey, substr(c, 1, 5) AS a, substr(c, 7, 5) AS d, list_sort(list(i)) AS days FROM cls WHERE kind IN ('both', 'garbage_only') GROUP BY 1, 2, 3),
s AS (SELECT c_custkey, string_agg(array_to_string(days, ',') || '@' || a || '-' || d, '|' ORDER BY days) AS txt FROM g GROUP BY 1),
h AS (SELECT c_custkey, substr(c, 14, 5) AS a, substr(c, 20, 5) AS d, list_sort(list(i)) AS days FROM cls WHERE kind = 'both' GROUP BY 1, 2, 3),
t AS (SELECT c_custkey, string_agg(array_to_string(days, ',') || '@' || a || '-' || d, '|' ORDER BY days) AS txt FROM h GROUP BY 1)
SELECT r.c_custkey, drop_reason, CASE WHEN drop_reason IS NULL THEN coalesce(s.txt, '') END AS schedule, CASE WHEN drop_reason IS NULL THEN coalesce(t.txt, '') END AS recycling,
  CASE WHEN drop_reason IS NULL THEN substr(split_part(s.txt, '@', 2), 1, 5) END AS first_arrive
FROM rows_ r LEFT JOIN s ON s.c_custkey = r.c_custkey LEFT JOIN t ON t.c_custkey = r.c_custkey""")
def cell_classify(v):
    out = N.grid_rows(grid_binding(v))
    return out.select("c_custkey", "drop_reason", entries_text("schedule").alias("schedule"), entries_text("recycling_schedule").alias("recycling"), "first_arrive")


@query("regroup_schedule", "v_entries", sql="""
SELECT ord, kind, arrive, depart, array_to_string(coalesce(list_sort(list(DISTINCT weekday) FILTER (WHERE weekday IS NOT NULL)), []), ',') AS days
FROM v_entries GROUP BY ord, kind, arrive, depart, weekday IS NULL""")
def regroup_schedule(v):
    return N.merge_entries(v.entries(), ["ord", "kind"]).select("ord", "kind", "arrive", "depart", F.array_join(F.col("weekday").cast("array<string>"), ",").alias("days"))


@query("sanitize_entries", "v_points v_merged", sql=f"""
SELECT ord, coalesce((SELECT {MERGED_TEXT} FROM v_merged m WHERE m.ord = p.ord AND kind = 'garbage'), '') AS schedule,
  (SELECT {MERGED_TEXT} FROM v_merged m WHERE m.ord = p.ord AND kind = 'recycling') AS recycling,
  (SELECT {MERGED_TEXT} FROM v_merged m WHERE m.ord = p.ord AND kind = 'foodscraps') AS foodscraps
FROM v_points p""")
def sanitize_entries(v):
    p = v.points_nested()
    # the raw form marks unknown days with NULL and carries the audit field
    raw = lambda c: F.transform(
        F.col(c),
        lambda e: F.struct(
            F.when(F.size(e["weekday"]) > 0, e["weekday"]).alias("weekday"), e["arrive"].alias("arrive"), e["depart"].alias("depart"), F.lit("listed").alias("weekday_source")
        ),
    )
    return p.select(
        "ord",
        entries_text(N.sanitize(raw("schedule"), True)).alias("schedule"),
        entries_text(N.sanitize(raw("recycling_schedule"), False)).alias("recycling"),
        entries_text(N.sanitize(raw("foodscraps_schedule"), False)).alias("foodscraps"),
    )


REASON_SQL = """CASE WHEN district = 'NATION_3' OR coalesce(district, '') = '' THEN 'missing_district' WHEN coalesce(point_name, '') = '' THEN 'missing_point_name'
  WHEN ord NOT IN (SELECT ord FROM v_entries WHERE ord IS NOT NULL) THEN 'empty_schedule_and_recycling' END"""


def classified(v):
    p = v.points_nested().withColumn("district", F.when(F.col("district") != "NATION_3", F.col("district")))
    return p.withColumn("reason", N.publish_reason(N.has_entries("schedule", "recycling_schedule", "foodscraps_schedule")))


@query("publishable", "v_points v_entries", sql=f"SELECT ord, {REASON_SQL} AS reason FROM v_points")
def publishable(v):
    return classified(v).select("ord", "reason")


ID_SQL = "CASE WHEN c_custkey % 10 = 0 THEN concat('TYN-', CAST(c_custkey AS {s})) WHEN c_custkey % 10 = 1 THEN concat('TYN--', CAST(c_custkey AS {s})) WHEN c_custkey % 10 = 2 THEN concat('TYN-LuZhu-', CAST(c_custkey AS {s}), '--x') ELSE concat('TYN-LuZhu-', CAST(c_custkey AS {s}), CASE WHEN c_custkey % 2 = 0 THEN '-B' ELSE '' END) END"


@query("parse_id", sql=f"""
SELECT c_custkey, CASE WHEN c_custkey % 10 > 2 THEN 'luzhu' END AS district_slug,
  CASE WHEN c_custkey % 10 > 2 THEN concat(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN '-B' ELSE '' END) END AS point_slug,
  CASE WHEN c_custkey % 10 > 2 THEN concat('TYN-LUZHU-', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN '-B' ELSE '' END) END AS rebuilt,
  CASE WHEN c_custkey % 10 > 2 THEN c_custkey % 2 <> 0 END AS legacy
FROM customer""")
def parse_id(v):
    district, slug = N.parse_id(F.expr(ID_SQL.format(s="STRING")))
    return v.table("customer").select("c_custkey", district.alias("district_slug"), slug.alias("point_slug")).select(
        "*", N.build_id(F.lit("TYN"), F.col("district_slug"), F.col("point_slug")).alias("rebuilt"), N.is_legacy_slug(F.col("point_slug")).alias("legacy")
    )


@query("time_text", "v_entries v_points", sql="""
SELECT seq, CASE WHEN collection_type = 'PASS' THEN CASE WHEN depart IS NULL OR arrive = depart THEN '約 ' || arrive || ' 經過' ELSE '約 ' || arrive || '〜' || depart || ' 經過' END
  WHEN depart IS NULL THEN '約 ' || arrive || ' 抵達' ELSE arrive || '〜' || depart END AS txt
FROM v_entries JOIN v_points USING (ord)""")
def time_text(v):
    joined = v.entries().join(v.points().select("ord", "collection_type"), ["ord"], "inner")
    return joined.select("seq", times.time_text(F.col("arrive"), F.col("depart"), F.col("collection_type") == "PASS").alias("txt"))


@query("union_by_key", "v_stops", sql="""
WITH r AS (SELECT route_id, poi_id, car_type, bare, row_number() OVER (PARTITION BY route_id, poi_id, car_type ORDER BY l_orderkey * 10 + l_linenumber DESC, bare DESC) AS rn FROM v_stops),
l AS (SELECT * FROM r WHERE rn = 1 AND car_type = 'lagi'), c AS (SELECT * FROM r WHERE rn = 1 AND car_type = 'recycle')
SELECT coalesce(l.route_id, c.route_id) AS route_id, coalesce(l.poi_id, c.poi_id) AS poi_id, coalesce(l.bare, c.bare) AS bare,
  CASE WHEN l.poi_id IS NULL THEN 'recycle_only' WHEN c.poi_id IS NULL THEN 'lagi_only' ELSE 'both' END AS present
FROM l FULL JOIN c ON l.route_id = c.route_id AND l.poi_id = c.poi_id""")
def union_by_key(v):
    stops = v.stops().withColumn("file", F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("bare")))
    return N.union_by_key(stops, ["route_id", "poi_id"], "car_type", "lagi", "recycle", "file", ["bare"]).select("route_id", "poi_id", "bare", "present")


@query("json_roundtrip", "v_points v_merged", sql="""
SELECT p.ord, count(m.ord) AS n_entries, coalesce(sum(len(days)), 0)::BIGINT AS n_days, min(arrive) AS min_arrive, count(m.ord) - count(depart) AS open_ended
FROM v_points p LEFT JOIN v_merged m ON m.ord = p.ord AND kind = 'garbage' GROUP BY 1""")
def json_roundtrip(v):
    p = v.points_nested().select("ord", F.to_json("schedule", {"ignoreNullFields": "false"}).alias("schedule_json"))
    back = p.select("ord", F.from_json("schedule_json", N.ENTRIES).alias("s"))
    return back.select(
        "ord",
        F.size("s").cast("long").alias("n_entries"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + F.size(e["weekday"])).alias("n_days"),
        F.array_min(F.transform("s", lambda e: e["arrive"])).alias("min_arrive"),
        F.size(F.filter("s", lambda e: e["depart"].isNull())).cast("long").alias("open_ended"),
    )


ROC = "CASE WHEN o_orderkey % 7 = 0 THEN '下載日期' ELSE concat(CAST(100 + o_orderkey % 20 AS {s}), '年', CAST(o_orderkey % 13 + 1 AS {s}), '月', CAST(o_orderkey % 28 + 1 AS {s}), '日') END"


@query("roc_date", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 13 < 12 THEN strftime(make_date(CAST(2011 + o_orderkey % 20 AS INT), CAST(o_orderkey % 13 + 1 AS INT), CAST(o_orderkey % 28 + 1 AS INT)), '%Y-%m-%d') END AS d
FROM orders""")
def roc_date(v):
    return v.table("orders").select("o_orderkey", dates.roc_date(F.expr(ROC.format(s="STRING"))).cast("string").alias("d"))


@query("weekday_of", "v_asof", sql=f"""
SELECT CAST(as_of AS VARCHAR) AS as_of, CAST(isodow(as_of) AS INT) AS weekday, {WEEKDAY_SQL}[isodow(as_of)] AS label,
  '今天:' || strftime(as_of, '%Y/%m/%d') || ' 週' || {WEEKDAY_SQL}[isodow(as_of)] AS line,
  month(as_of) || '/' || day(as_of) || '(' || {WEEKDAY_SQL}[isodow(as_of)] || ')' AS short, count(*) AS n
FROM v_asof GROUP BY as_of""")
def weekday_of(v):
    d = F.col("as_of")
    days = v.asof_dates().groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))
    return days.select(
        d.cast("string").alias("as_of"), dates.iso_weekday(d).alias("weekday"), dates.weekday_label(d).alias("label"), dates.date_line(d).alias("line"), dates.short_date(d).alias("short"), "n"
    )


@query("content_hash", "v_points", sql="""
SELECT ord, upper(substr(sha256(coalesce(village, '') || '|' || coalesce(point_name, 'None')), 1, 10)) AS hash FROM v_points""")
def content_hash(v):
    from schedlake.operators.identity import base_key

    return v.points().select("ord", text.content_id(base_key(F.col("village"), F.col("point_name"))).alias("hash"))


@query("variant_bucket", "v_points", sql="""
WITH RECURSIVE h AS (SELECT ord, point_id, 0::BIGINT AS h, 1 AS i FROM v_points
  UNION ALL SELECT ord, point_id, (h * 31 + unicode(substr(point_id, i, 1))) % 4294967296, i + 1 FROM h WHERE i <= length(point_id))
SELECT ord, h AS hash, CAST(h % 3 AS INT) AS variant FROM h WHERE i > length(point_id)""")
def variant_bucket(v):
    return v.points().select("ord", text.rolling_hash(F.col("point_id")).alias("hash")).withColumn("variant", text.variant(F.col("hash"), 3))


@query("text_normalize", sql="""
SELECT doc_id, length(t) AS n, md5(t) AS digest FROM
  (SELECT doc_id, regexp_replace(replace(lower(text), '臺', '台'), '[\\s\\p{P}\\p{S}]', '', 'g') AS t FROM documents)""")
def text_normalize(v):
    docs = v.table("documents").select("doc_id", text.search_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("url_host_map", sql="""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
d AS (SELECT host, 'site ' || host AS name FROM u WHERE host NOT LIKE 'm.%' GROUP BY host)
SELECT page_id, u.host, name, name IS NULL AS missing FROM u LEFT JOIN d ON u.host = d.host""")
def url_host_map(v):
    from schedlake.operators.quality import host_names

    pages = v.table("pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))
    names = pages.filter(~F.col("host").startswith("m.")).groupBy("host").agg(F.concat(F.lit("site "), F.first("host")).alias("name"))
    return host_names(pages, names)
