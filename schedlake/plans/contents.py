"""Queries of the texts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.functions import phrases as P
from schedlake.functions.text import address, map_terms, path_url
from schedlake.operators import calendar as C
from schedlake.operators import content as T
from schedlake.operators import proximity as X
from schedlake.operators import publish as U
from schedlake.operators import service as S
from schedlake.operators import stats
from schedlake.plans.calendars import block_sql, lw_sql
from schedlake.plans.districts import PER_POINT
from schedlake.plans.places import FALLBACK_SQL, GEO, STATUS_CTE
from schedlake.plans.registry import query

NAMES = "['一', '二', '三', '四', '五', '六', '日']"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def district_stats(v):
    names = v.points().select("city_slug", "district_slug", "district").distinct()
    return stats.district_stats(v.points(), v.entries()).join(names, stats.DISTRICT)


SENTENCE_CTE = f"""
WITH RECURSIVE {PER_POINT.strip()},
w AS (SELECT city_slug, district_slug, unnest([1, 2, 3, 4, 5, 6, 7]) AS wd, unnest([wd1, wd2, wd3, wd4, wd5, wd6, wd7]) AS n FROM ds),
m AS (SELECT *, max(n) OVER (PARTITION BY city_slug, district_slug) AS top, '週' || {NAMES}[wd] AS nm FROM w),
ws AS (SELECT city_slug, district_slug, any_value(top) AS top, string_agg(nm, '、' ORDER BY wd) FILTER (WHERE 2 * n >= top) AS nd, min(n) FILTER (WHERE 2 * n >= top) AS lo, max(n) FILTER (WHERE 2 * n >= top) AS hi,
  string_agg(nm || '僅 ' || n || ' 個點', '、' ORDER BY wd) FILTER (WHERE 2 * n < top AND n > 0) AS low, string_agg(nm, '、' ORDER BY wd) FILTER (WHERE 2 * n < top AND n = 0) AS zero FROM m GROUP BY 1, 2),
st AS (SELECT ds.*, hour_counts, CASE WHEN top > 0 THEN concat_ws(';', nd || CASE WHEN lo = hi THEN ' ' || lo ELSE '約 ' || lo || '–' || hi END || ' 個點有班次', low, zero || '目前沒有登記的收運班次') || '。' END AS weekday_text
  FROM ds JOIN ws USING (city_slug, district_slug) JOIN ht USING (city_slug, district_slug))"""


#: The four questions of a district, in order; a question without an answer is left out.
FAQ_CTE = SENTENCE_CTE + """,
i AS (SELECT city_slug, district_slug, 1 AS k, district || '星期幾有收垃圾?' AS question, coalesce('根據本站資料,' || district || weekday_text, '本站尚未取得' || district || '清運點的逐日收運星期資料,僅取得到站時間,請見下方時段總表。') AS answer FROM st WHERE point_count > no_schedule_points
  UNION ALL SELECT city_slug, district_slug, 2, district || '有幾個清運點?', district || '目前共登記 ' || point_count || ' 個清運點,分布在 ' || village_count || ' 個里。' FROM st
  UNION ALL SELECT city_slug, district_slug, 3, district || '最早、最晚的清運時間是幾點?', district || '記錄到的清運到站時間中,最早為 ' || earliest_arrive || ',最晚為 ' || latest_arrive || '。' FROM st WHERE earliest_arrive IS NOT NULL
  UNION ALL SELECT city_slug, district_slug, 4, district || '有資源回收或廚餘回收嗎?', district || '的清運點中,' || concat_ws('、', CASE WHEN recycling_points > 0 THEN '有 ' || recycling_points || ' 個(約 ' || recycling_pct || '%)提供資源回收' END,
    CASE WHEN foodscraps_points > 0 THEN '有 ' || foodscraps_points || ' 個(約 ' || foodscraps_pct || '%)提供廚餘回收' END) || '。' FROM st WHERE recycling_points + foodscraps_points > 0)"""


@query("district_faq", "v_points v_entries", sql=FAQ_CTE + """
SELECT city_slug, district_slug, CAST(row_number() OVER (PARTITION BY city_slug, district_slug ORDER BY k) AS INT) AS position, question, answer FROM i""")
def district_faq(v):
    return T.district_faq(district_stats(v), stats.DISTRICT)


@query("district_text", "v_points v_entries", sql=SENTENCE_CTE + f""",
hx AS (SELECT city_slug, district_slug, 0::BIGINT AS h, 1 AS i FROM st UNION ALL SELECT city_slug, district_slug, (h * 31 + unicode(substr(district_slug, i, 1))) % 4294967296, i + 1 FROM hx WHERE i <= length(district_slug)),
hc AS (SELECT city_slug, district_slug, CAST(unnest(string_split(hour_counts, ',')) AS BIGINT) AS n, generate_subscripts(string_split(hour_counts, ','), 1) - 1 AS hr FROM st),
pk AS (SELECT city_slug, district_slug, max(n) AS peak FROM hc GROUP BY 1, 2),
pt AS (SELECT hc.city_slug, hc.district_slug, peak, count(*) AS ties, string_agg(hr || '時', '、' ORDER BY hr) AS hours FROM hc JOIN pk ON pk.city_slug = hc.city_slug AND pk.district_slug = hc.district_slug AND n = peak GROUP BY 1, 2, 3)
SELECT st.city_slug, st.district_slug, weekday_text,
  nullif(concat_ws(';', CASE WHEN weekday_unknown_points > 0 THEN '另有 ' || weekday_unknown_points || ' 個點的收運星期本站尚未取得,未列入以上統計(到站時間仍列在下方時段總表中)' END,
    CASE WHEN no_schedule_points > 0 THEN '另有 ' || no_schedule_points || ' 個點僅提供資源回收或廚餘回收服務,無一般垃圾收運班次,未列入以上統計' END), '') || '。' AS caveat,
  CASE WHEN earliest_arrive = latest_arrive THEN '全區到站時間集中在 ' || earliest_arrive ELSE '全區到站時間最早 ' || earliest_arrive || ',最晚 ' || latest_arrive END
    || CASE WHEN peak > 1 AND ties <= 3 THEN ',收運時段以 ' || hours || ' 最為集中(共 ' || peak || ' 筆班次)' ELSE '' END || '。' AS time_text,
  replace(replace(replace(CASE WHEN h % 2 = 0 THEN {quote(P.DISTRICT_NOTE[0])} ELSE {quote(P.DISTRICT_NOTE[1])} END, '{{district}}', district), '{{points}}', CAST(point_count AS VARCHAR)), '{{villages}}', CAST(village_count AS VARCHAR)) AS note
FROM st JOIN pt ON pt.city_slug = st.city_slug AND pt.district_slug = st.district_slug JOIN hx ON hx.city_slug = st.city_slug AND hx.district_slug = st.district_slug AND i > length(st.district_slug)""")
def district_text(v):
    return T.district_text(district_stats(v), stats.DISTRICT)


def summarised(v):
    p = v.points_nested().withColumn("address", address(F.col("city"), F.col("district"), F.col("point_name")))
    return T.point_summary(p, F.col("collection_type") == "PASS")


HASHES = "hx AS (SELECT ord, point_id, 0::BIGINT AS h, 1 AS i FROM v_points UNION ALL SELECT ord, point_id, (h * 31 + unicode(substr(point_id, i, 1))) % 4294967296, i + 1 FROM hx WHERE i <= length(point_id))"
INTRO_ROWS = ", ".join(f"('{shape}', {len(texts)}, {i}, {quote(t)})" for shape, texts in P.INTRO.items() for i, t in enumerate(texts))
DAY_ROWS = ", ".join(f"('{shape}', {len(texts)}, {offset}, {i}, {quote(t)})" for shape, (offset, texts) in P.DAY.items() for i, t in enumerate(texts))


@query("point_summary", "v_points v_merged", sql=f"""
WITH RECURSIVE {HASHES},
tp(shape, n, i, text) AS (VALUES {INTRO_ROWS}),
kd AS (SELECT ord, min(CASE kind WHEN 'garbage' THEN 1 WHEN 'recycling' THEN 2 ELSE 3 END) AS k, coalesce(bool_or(kind = 'recycling'), FALSE) AS rc FROM v_merged GROUP BY 1),
le AS (SELECT m.*, k, rc FROM v_merged m JOIN kd ON kd.ord = m.ord AND CASE kind WHEN 'garbage' THEN 1 WHEN 'recycling' THEN 2 ELSE 3 END = k),
lf AS (SELECT ord, any_value(k) AS k, any_value(rc) AS rc, arg_min(arrive, (days, arrive, coalesce(depart, ''))) AS arrive, nullif(arg_min(coalesce(depart, ''), (days, arrive, coalesce(depart, ''))), '') AS depart,
  list_sort(list_distinct(flatten(list(days)))) AS ds, count(DISTINCT (arrive, coalesce(depart, ''))) > 1 AS varied FROM le GROUP BY 1),
s AS (SELECT p.*, lf.k, rc, arrive, depart, coalesce(ds, []) AS ds, varied, coalesce(collection_type = 'PASS', FALSE) AS passing, h FROM v_points p LEFT JOIN lf ON lf.ord = p.ord JOIN hx ON hx.ord = p.ord AND i > length(p.point_id)),
z AS (SELECT *, CASE WHEN k IS NULL THEN 'no_times' WHEN k > 1 THEN CASE WHEN len(ds) = 0 THEN 'other_unknown' WHEN varied THEN 'other_varied' ELSE 'other_fixed' END
  WHEN len(ds) = 0 THEN 'unknown' WHEN varied THEN 'varied' WHEN passing THEN 'passing' WHEN collection_type IS NOT NULL THEN 'typed' ELSE 'untyped' END AS shape,
  CASE WHEN depart IS NULL OR arrive = depart THEN '約 ' || arrive || ' 經過' ELSE '約 ' || arrive || '〜' || depart || ' 經過' END AS moment,
  CASE WHEN depart IS NULL THEN '到站時間約 ' || arrive ELSE '到站時間約在 ' || arrive || '〜' || depart || ' 之間' END AS arr FROM s)
SELECT z.ord, z.shape, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '{{where}}', coalesce(city || district || point_name, point_name, '')), '{{area}}', district || coalesce(village, '')),
  '{{spot}}', coalesce(village, district)), '{{name}}', coalesce(point_name, '')), '{{district}}', district), '{{service}}', CASE WHEN rc THEN '資源回收收運' ELSE '廚餘回收' END),
  '{{days}}', array_to_string(['週' || {NAMES}[d] FOR d IN ds], '、')), '{{time}}', coalesce(CASE WHEN passing THEN moment WHEN depart IS NULL THEN '約 ' || arrive || ' 抵達' ELSE arrive || '〜' || depart END, '')),
  '{{arrival}}', coalesce(CASE WHEN passing AND z.shape = 'unknown' THEN moment ELSE arr END, '')) AS summary
FROM z JOIN tp ON tp.shape = z.shape AND z.h % tp.n = tp.i""")
def point_summary(v):
    return summarised(v).select("ord", "shape", "summary")


@query("day_sentence", "v_points v_merged", sql="WITH RECURSIVE " + STATUS_CTE.strip()[5:] + f""",
{HASHES}, tp(shape, n, "off", i, text) AS (VALUES {DAY_ROWS}),
kn AS (SELECT ord, list_sort(list_distinct(flatten(list(days)))) AS ds FROM v_merged WHERE kind = 'garbage' GROUP BY 1),
hd AS (SELECT d.ord, d.today, nullif(arg_min(coalesce(depart, ''), (days, arrive, coalesce(depart, ''))), '') AS depart FROM d JOIN v_merged m ON m.ord = d.ord AND kind = 'garbage' AND list_contains(days, d.today) GROUP BY 1, 2),
x AS (SELECT d.ord, d.today, h.arrive, hd.depart, point_name, ds, hx.h AS hash, CASE WHEN coalesce(g, 0) = 0 THEN CASE WHEN r > 0 THEN 'recycling_only' WHEN f > 0 THEN 'foodscraps_only' ELSE 'no_data' END
  WHEN h.arrive IS NOT NULL THEN CASE WHEN collection_type = 'PASS' THEN 'passing' WHEN hd.depart IS NOT NULL THEN 'window' WHEN collection_type IS NOT NULL THEN 'arrive_typed' ELSE 'arrive_untyped' END
  WHEN has_known THEN 'other_days' ELSE 'weekday_unknown' END AS shape
  FROM d JOIN v_points p ON p.ord = d.ord LEFT JOIN s ON s.ord = d.ord LEFT JOIN h ON h.ord = d.ord AND h.today = d.today LEFT JOIN hd ON hd.ord = d.ord AND hd.today = d.today LEFT JOIN kn ON kn.ord = d.ord
  JOIN hx ON hx.ord = d.ord AND hx.i > length(p.point_id))
SELECT x.ord, CAST(x.today AS INT) AS today, x.shape, replace(replace(replace(replace(replace(replace(text, '{{name}}', coalesce(point_name, '這個清運點')), '{{today}}', '週' || {NAMES}[x.today]),
  '{{days}}', coalesce(array_to_string(['週' || {NAMES}[d] FOR d IN ds], '、'), '')), '{{moment}}', coalesce(CASE WHEN depart IS NULL OR arrive = depart THEN '約 ' || arrive ELSE '約 ' || arrive || '〜' || depart END, '')),
  '{{arrive}}', coalesce(arrive, '')), '{{depart}}', coalesce(depart, '')) AS sentence
FROM x JOIN tp ON tp.shape = x.shape AND (x.hash + tp."off") % tp.n = tp.i""")
def day_sentence(v):
    return T.day_sentence(S.day_status(v.points_nested()), F.col("collection_type") == "PASS").select("ord", "today", "shape", "sentence")


POINT_FAQ_ROWS = ", ".join(f"({k}, {quote(q)}, {i}, {quote(a)})" for k, (q, answers) in enumerate(P.POINT_FAQ) for i, a in enumerate(answers))


@query("point_faq", "v_points", sql=f"""
WITH RECURSIVE {HASHES}, {FALLBACK_SQL.strip()},
sm AS (SELECT ord, bool_and(same_village) AS all_same FROM n WHERE rank <= 5 GROUP BY 1),
tp(k, question, i, text) AS (VALUES {POINT_FAQ_ROWS}),
hd AS (SELECT p.*, CASE WHEN {GEO.format(a='p')} THEN '鄰近清運點' WHEN village IS NOT NULL AND coalesce(all_same, TRUE) THEN '同里的清運點' ELSE '同行政區的清運點' END AS heading FROM v_points p LEFT JOIN sm ON sm.ord = p.ord)
SELECT hd.ord, CAST(k + 1 AS INT) AS position, question, replace(replace(replace(replace(text, '{{name}}', coalesce(point_name, '')), '{{heading}}', heading), '{{district}}', district), '{{city}}', city) AS answer
FROM hd JOIN hx ON hx.ord = hd.ord AND hx.i > length(hd.point_id) JOIN tp ON (hx.h + k) % 2 = tp.i""")
def point_faq(v):
    return T.point_faq(v.points(), X.neighbour_heading(v.points()))


@query("place_docs", "v_points", sql=f"""
SELECT ord, CASE WHEN {GEO.format(a='p')} THEN to_json({{'@context': 'https://schema.org', '@type': 'Place', 'name': coalesce(point_name, ''), 'address': coalesce(city || district || point_name, ''),
  'geo': {{'@type': 'GeoCoordinates', 'latitude': lat, 'longitude': lng}}, 'url': 'https://example.org/' || city_slug || '/' || ord || '/'}})::VARCHAR END AS place,
  to_json({{'@context': 'https://schema.org', '@type': 'BreadcrumbList', 'itemListElement': [{{'@type': 'ListItem', 'position': 1, 'name': city, 'item': 'https://example.org/' || city_slug || '/'}},
    {{'@type': 'ListItem', 'position': 2, 'name': district, 'item': 'https://example.org/' || city_slug || '/' || district_slug || '/'}}]}})::VARCHAR AS breadcrumb FROM v_points p""")
def place_docs(v):
    p = v.points().withColumn("address", F.coalesce(address(F.col("city"), F.col("district"), F.col("point_name")), F.lit("")))
    p = p.withColumn("point_name", F.coalesce("point_name", F.lit("")))
    base = "https://example.org"
    crumbs = T.breadcrumb_doc([(F.col("city"), path_url(base, F.col("city_slug"))), (F.col("district"), path_url(base, F.col("city_slug"), F.col("district_slug")))])
    return p.select("ord", T.place_doc(path_url(base, F.col("city_slug"), F.col("ord").cast("string"))).alias("place"), crumbs.alias("breadcrumb"))


@query("faq_docs", "v_points v_entries", sql=FAQ_CTE + """
SELECT city_slug, district_slug, to_json({'@context': 'https://schema.org', '@type': 'FAQPage',
  'mainEntity': list({'@type': 'Question', 'name': question, 'acceptedAnswer': {'@type': 'Answer', 'text': answer}} ORDER BY k)})::VARCHAR AS doc FROM i GROUP BY 1, 2""")
def faq_docs(v):
    return T.faq_docs(T.district_faq(district_stats(v), stats.DISTRICT), stats.DISTRICT)


@query("unknown_notice", "v_points", sql="""
SELECT ord, '本站僅取得此清運點的到點時間,未取得收運星期。完整班表請以' || CASE WHEN city IN ('ASIA', 'AFRICA') THEN city || ' lookup' ELSE '官方查詢系統' END || '為準。' AS notice FROM v_points""")
def unknown_notice(v):
    systems = v.table("region").filter("r_name in ('ASIA', 'AFRICA')").select(F.col("r_name").alias("city"), F.concat("r_name", F.lit(" lookup")).alias("name"))
    return T.unknown_weekday_notice(v.points(), systems)


@query("term_forms", "v_points", sql="""
SELECT ord, district, CASE WHEN (SELECT n_nationkey FROM nation WHERE n_name = district) % 2 = 0 THEN 'N' || (SELECT n_nationkey FROM nation WHERE n_name = district) ELSE district END AS form FROM v_points""")
def term_forms(v):
    """District names in the other form of a dictionary that knows every second one."""
    terms = v.table("nation").filter("n_nationkey % 2 = 0").selectExpr("n_name AS term", "concat('N', CAST(n_nationkey AS STRING)) AS form")
    return map_terms(v.points().select("ord", "district"), "district", terms, "form")


@query("sitemap_static", "v_calendar v_occasions", sql="WITH " + lw_sql("v_calendar").strip() + "," + block_sql("v_calendar") + """,
n AS (SELECT *, rn0 - lag(rn1) OVER w - 1 AS gb, lead(rn0) OVER w - rn1 - 1 AS ga FROM b WINDOW w AS (PARTITION BY year ORDER BY start))
SELECT 'https://example.org/calendar/' || year || '/' AS loc FROM (SELECT DISTINCT year FROM lw) UNION ALL SELECT 'https://example.org/calendar/' || year || '/' || strftime(start, '%m%d') || '/' FROM lw
UNION ALL SELECT 'https://example.org/calendar/' || year || '/leave-plan/' FROM (SELECT DISTINCT year FROM n WHERE len(named) > 0 AND (gb BETWEEN 1 AND 3 OR ga BETWEEN 1 AND 3))
UNION ALL SELECT 'https://example.org/calendar/' || year || '/foreign/' FROM (SELECT DISTINCT year FROM lw)
UNION ALL SELECT 'https://example.org/lunar/entity/' || s || '/' FROM (SELECT DISTINCT lower(replace(deity_name, '#', '-')) AS s FROM v_occasions)
UNION ALL SELECT 'https://example.org/apps/' || lower(n_name) || '/' FROM nation WHERE n_nationkey % 3 = 0""")
def sitemap_static(v):
    cal = v.calendar()
    entities = v.occasions().select(F.lower(F.replace(F.col("deity_name"), F.lit("#"), F.lit("-"))).alias("slug"))
    registry = v.table("nation").selectExpr("lower(n_name) AS slug", "CASE WHEN n_nationkey % 3 = 0 THEN 'live' ELSE 'draft' END AS status")
    return U.static_pages("https://example.org", C.long_weekends(cal), C.leave_plans(cal), entities, registry)
