"""Queries of neighbours and weekly service."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions.times import weekday_bit
from schedlake.operators import calendar as C
from schedlake.operators import proximity as X
from schedlake.operators import service as S
from schedlake.plans.registry import query

GEO = "coalesce({a}.lat BETWEEN 21.5 AND 25.5 AND {a}.lng BETWEEN 119.5 AND 122.5, FALSE)"
KM = (
    "round(2 * 6371 * atan2(sqrt(hav), sqrt(1 - hav)), 9)"
)
HAV = (
    "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)"
)


@query("knn_geo", "v_points", sql=f"""
WITH h AS (SELECT a.ord, b.ord AS neighbour, {HAV} AS hav FROM v_points a JOIN v_points b ON a.city_slug = b.city_slug AND a.district_slug = b.district_slug AND a.ord <> b.ord
  WHERE {GEO.format(a='a')} AND {GEO.format(a='b')}),
r AS (SELECT ord, neighbour, {KM} AS km FROM h), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY km, neighbour) AS INT) AS rank FROM r)
SELECT ord, rank, neighbour, round(km, 6) AS km FROM n WHERE rank <= 5""")
def knn_geo(v):
    return X.knn_geo(v.points()).withColumn("km", F.round("km", 6))


FALLBACK_SQL = f"""
f AS (SELECT a.ord, b.ord AS neighbour, coalesce(a.village = b.village, FALSE) AS same_village FROM v_points a JOIN v_points b ON a.city_slug = b.city_slug AND a.district_slug = b.district_slug AND a.ord <> b.ord
  WHERE NOT {GEO.format(a='a')}),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY NOT same_village, neighbour) AS INT) AS rank FROM f)"""


@query("knn_fallback", "v_points", sql="WITH " + FALLBACK_SQL.strip() + " SELECT ord, rank, neighbour, same_village FROM n WHERE rank <= 5")
def knn_fallback(v):
    return X.knn_fallback(v.points())


@query("neighbour_heading", "v_points", sql="WITH " + FALLBACK_SQL.strip() + f""",
s AS (SELECT ord, bool_and(same_village) AS all_same FROM n WHERE rank <= 5 GROUP BY 1)
SELECT p.ord, CASE WHEN {GEO.format(a='p')} THEN '鄰近清運點' WHEN village IS NOT NULL AND coalesce(all_same, TRUE) THEN '同里的清運點' ELSE '同行政區的清運點' END AS heading FROM v_points p LEFT JOIN s ON s.ord = p.ord""")
def neighbour_heading(v):
    return X.neighbour_heading(v.points())


@query("knn_candidates", "v_points", sql=f"""
WITH pr AS (SELECT a.ord, a.lat, a.lng, a.village, b.ord AS neighbour, b.lat AS blat, b.lng AS blng, coalesce(a.village = b.village, FALSE) AS same FROM v_points a JOIN v_points b ON a.city_slug = b.city_slug AND a.district_slug = b.district_slug AND a.ord <> b.ord),
w AS (SELECT ord, count(*) FILTER (WHERE same) < 15 AS wide FROM pr GROUP BY 1),
c AS (SELECT pr.*, wide FROM pr JOIN w USING (ord) WHERE wide OR same),
g AS (SELECT a.ord, neighbour, wide, same, {GEO.format(a='a')} AS geo, coalesce(blat BETWEEN 21.5 AND 25.5 AND blng BETWEEN 119.5 AND 122.5, FALSE) AS bgeo,
  pow(sin(radians(blat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(blat)) * pow(sin(radians(blng - a.lng) / 2), 2) AS hav FROM c a),
k AS (SELECT *, CASE WHEN geo THEN {KM} WHEN same THEN 0 ELSE 1 END AS sort FROM g WHERE NOT geo OR bgeo),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY sort, neighbour) AS INT) AS rank FROM k)
SELECT ord, rank, neighbour, wide FROM n WHERE rank <= 5""")
def knn_candidates(v):
    return X.knn_candidates(v.points())


@query("weekday_times", "v_entries", sql="""
SELECT ord, weekday, string_agg(DISTINCT arrive, ',' ORDER BY arrive) AS times FROM v_entries WHERE kind = 'garbage' AND weekday IS NOT NULL GROUP BY 1, 2""")
def weekday_times(v):
    return S.weekday_times(v.entries()).withColumn("times", F.array_join("times", ","))


@query("next_run", "v_entries", sql="""
WITH a AS (SELECT event_id, user_id AS ord, CAST(isodow(ts) AS INT) AS weekday, strftime(ts, '%H:%M') AS now FROM events),
w AS (SELECT DISTINCT ord, weekday AS day, arrive FROM v_entries WHERE kind = 'garbage' AND weekday IS NOT NULL),
o AS (SELECT a.*, day, arrive, CASE WHEN day = a.weekday AND arrive < now THEN 7 ELSE (day - a.weekday + 7) % 7 END AS "offset" FROM a LEFT JOIN w ON w.ord = a.ord),
k AS (SELECT *, "offset" * 1440 + CAST(substr(arrive, 1, 2) AS INT) * 60 + CAST(substr(arrive, 4, 2) AS INT) AS key, row_number() OVER (PARTITION BY event_id ORDER BY "offset" * 1440 + CAST(substr(arrive, 1, 2) AS INT) * 60 + CAST(substr(arrive, 4, 2) AS INT)) AS rn FROM o)
SELECT event_id, ord, weekday, now, CAST(key AS INT) AS key, CAST("offset" AS INT) AS "offset", arrive AS time,
  CASE "offset" WHEN 0 THEN '今天' WHEN 1 THEN '明天' ELSE '週' || ['一', '二', '三', '四', '五', '六', '日'][day] END || ' ' || arrive AS label FROM k WHERE rn = 1""")
def next_run(v):
    ts = F.col("ts")
    asks = v.table("events").select("event_id", F.col("user_id").alias("ord"), (F.weekday(ts) + 1).alias("weekday"), F.date_format(ts, "HH:mm").alias("now"))
    return S.next_run(asks, v.entries(), "event_id").orderBy(F.col("key").asc_nulls_last(), "event_id")


STATUS_CTE = """
WITH s AS (SELECT ord, count(*) FILTER (WHERE kind = 'garbage') AS g, count(*) FILTER (WHERE kind = 'recycling') AS r, count(*) FILTER (WHERE kind = 'foodscraps') AS f,
  coalesce(string_agg(DISTINCT arrive, '、' ORDER BY arrive) FILTER (WHERE kind = 'garbage' AND len(days) = 0), '') AS unknown_times,
  coalesce(bool_or(kind = 'garbage' AND len(days) = 0), FALSE) AS has_unknown, coalesce(bool_or(kind = 'garbage' AND len(days) > 0), FALSE) AS has_known FROM v_merged GROUP BY 1),
d AS (SELECT p.ord, unnest([1, 2, 3, 4, 5, 6, 7]) AS today FROM v_points p),
h AS (SELECT d.ord, d.today, arg_min(arrive, (days, arrive, coalesce(depart, ''))) AS arrive FROM d JOIN v_merged m ON m.ord = d.ord AND kind = 'garbage' AND list_contains(days, d.today) GROUP BY 1, 2)
"""


@query("point_status", "v_points v_merged", sql=STATUS_CTE + """
SELECT d.ord, CAST(d.today AS INT) AS today, CASE WHEN coalesce(g, 0) = 0 THEN CASE WHEN r > 0 THEN 'recycling_only' WHEN f > 0 THEN 'foodscraps_only' ELSE 'no_data' END
  WHEN h.arrive IS NOT NULL THEN 'service_today' WHEN has_known THEN 'other_days' ELSE 'weekday_unknown' END AS status, h.arrive, coalesce(unknown_times, '') AS unknown_times, coalesce(has_unknown, FALSE) AS has_unknown
FROM d LEFT JOIN s ON s.ord = d.ord LEFT JOIN h ON h.ord = d.ord AND h.today = d.today""")
def point_status(v):
    out = S.day_status(v.points_nested())
    return out.select("ord", "today", "status", F.col("hit.arrive").alias("arrive"), "unknown_times", "has_unknown")


@query("holiday_service", "v_entries v_calendar", sql="""
WITH m AS (SELECT DISTINCT ord, weekday FROM v_entries WHERE kind = 'garbage' AND weekday IS NOT NULL),
x AS (SELECT seq, e.ord, CAST(o_orderdate AS DATE) AS d FROM v_entries e JOIN orders ON o_orderkey = seq)
SELECT seq, x.ord, CAST(x.d AS VARCHAR) AS d, m.ord IS NOT NULL AS served, CASE WHEN m.ord IS NULL THEN 'no_service' WHEN c.d IS NOT NULL THEN 'holiday_notice' ELSE 'service' END AS line
FROM x LEFT JOIN m ON m.ord = x.ord AND m.weekday = isodow(x.d) LEFT JOIN (SELECT d FROM v_calendar WHERE is_holiday AND memo <> '') c ON c.d = x.d""")
def holiday_service(v):
    visits = v.table("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("ord"), F.to_date("o_orderdate").alias("d"))
    masks = v.entries().filter("kind = 'garbage'").groupBy("ord").agg(F.bit_or(weekday_bit(F.col("weekday"))).alias("mask"))
    out = S.holiday_service(visits, masks, C.holiday_dates(v.calendar()), "seq")
    return out.withColumn("d", F.col("d").cast("string"))
