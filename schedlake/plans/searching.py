"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import search as S
from schedlake.plans.registry import query


def places(v):
    """Points whose city and district names carry the usual suffixes."""
    return v.points().withColumn("city", F.concat("city", F.lit("市"))).withColumn("district", F.concat("district", F.lit("區")))


def asked(v):
    """Queries in six spellings, one per point."""
    bare_city, bare_district = F.regexp_replace("city", "市$", ""), F.regexp_replace("district", "區$", "")
    kind = F.col("ord") % 6
    text = (
        F.when(kind == 0, F.concat("city", "district", "point_name"))
        .when(kind == 1, F.concat(bare_city, F.lit(" "), bare_district, F.lit(","), F.col("point_name")))
        .when(kind == 2, F.concat(bare_district, "point_name", F.lit(" "), "village"))
        .when(kind == 3, F.concat("point_name", "village"))
        .when(kind == 4, F.concat("city", F.lit("區"), "point_name"))
        .otherwise(F.concat(bare_district, F.lit("路")))
    )
    return places(v).select(text.alias("text")).filter("text is not null")


CITY_RANK = "cd AS (SELECT city_slug, CAST(row_number() OVER (ORDER BY min(ord)) - 1 AS INT) AS city_idx FROM v_points GROUP BY 1)"
DIST_RANK = "dd AS (SELECT p.city_slug, district_slug, any_value(district) AS district, any_value(p.city) AS city, city_idx, CAST(row_number() OVER (ORDER BY city_idx, min(ord)) - 1 AS INT) AS district_idx FROM v_points p JOIN cd ON cd.city_slug = p.city_slug GROUP BY p.city_slug, district_slug, city_idx)"


@query("search_index", "v_points", sql=f"""
WITH {CITY_RANK}, {DIST_RANK}
SELECT ord, city_idx, district_idx, coalesce(point_name, '') AS name, village, split_part(point_id, '-', 3) AS point_slug FROM v_points p JOIN dd ON dd.city_slug = p.city_slug AND dd.district_slug = p.district_slug""")
def search_index(v):
    return S.search_index(v.points())[0]


NORM = "lower(regexp_replace({x}, '[\\s\\p{{P}}\\p{{S}}]', '', 'g'))"


@query("address_search", "v_points", sql=f"""
WITH {CITY_RANK}, {DIST_RANK},
t AS (SELECT CASE ord % 6 WHEN 0 THEN city || '市' || district || '區' || point_name WHEN 1 THEN city || ' ' || district || ',' || point_name WHEN 2 THEN district || point_name || ' ' || village
  WHEN 3 THEN point_name || village WHEN 4 THEN city || '市區' || point_name ELSE district || '路' END AS text FROM v_points),
q AS (SELECT DISTINCT {NORM.format(x='text')} AS q FROM t WHERE text IS NOT NULL),
cn AS (SELECT DISTINCT city_idx, {NORM.format(x='city')} AS core, {NORM.format(x='city')} || '市' AS "full" FROM dd),
cm AS (SELECT q, city_idx, core, "full", strpos(q, "full") AS f, strpos(q, core) AS c FROM q, cn),
cx AS (SELECT q, list(city_idx) FILTER (WHERE f > 0) AS fs, arg_min("full", city_idx) FILTER (WHERE f > 0) AS ft,
  list(city_idx) FILTER (WHERE c > 0 AND NOT regexp_matches(substr(q, c + length(core)), '^[路街道巷弄段里村號]')) AS cs,
  arg_min(core, city_idx) FILTER (WHERE c > 0 AND NOT regexp_matches(substr(q, c + length(core)), '^[路街道巷弄段里村號]')) AS ct FROM cm GROUP BY 1),
c2 AS (SELECT q, coalesce(fs, cs, []) AS cities, coalesce(ft, ct) AS tok FROM cx),
c3 AS (SELECT q, cities, CASE WHEN tok IS NULL THEN q ELSE substr(q, 1, strpos(q, tok) - 1) || substr(q, strpos(q, tok) + length(tok)) END AS rest FROM c2),
dn AS (SELECT city_idx, district_idx, {NORM.format(x='district')} AS core, {NORM.format(x='district')} || '區' AS "full" FROM dd),
dm AS (SELECT q, cities, rest, dn.*, strpos(rest, "full") AS f, strpos(rest, core) AS c FROM c3, dn WHERE len(cities) = 0 OR list_contains(cities, city_idx)),
dt AS (SELECT *, CASE WHEN f > 0 THEN "full" WHEN c > 0 AND length(substr(rest, c + length(core))) >= 2 AND NOT regexp_matches(substr(rest, c + length(core)), '^[路街道巷弄段里村號]') THEN core END AS tok FROM dm),
db AS (SELECT q, arg_min(tok, (-length(tok), district_idx)) AS tok FROM dt WHERE tok IS NOT NULL GROUP BY 1),
ds AS (SELECT db.q, db.tok, list(district_idx) AS districts FROM db JOIN dm ON dm.q = db.q AND (dm."full" = db.tok OR dm.core = db.tok) GROUP BY 1, 2),
pq AS (SELECT c3.q, cities, coalesce(districts, []) AS districts, CASE WHEN tok IS NULL THEN rest ELSE substr(rest, 1, strpos(rest, tok) - 1) || substr(rest, strpos(rest, tok) + length(tok)) END AS rest FROM c3 LEFT JOIN ds ON ds.q = c3.q),
nd AS (SELECT q, cities, districts, 1 AS stage, rest AS needle FROM pq WHERE len(cities) > 0 OR len(districts) > 0
  UNION ALL SELECT q, cities, districts, 2, regexp_replace(rest, '^[台市區縣鄉鎮]+|[台市區縣鄉鎮]+$', '', 'g') FROM pq WHERE (len(cities) > 0 OR len(districts) > 0) AND regexp_replace(rest, '^[台市區縣鄉鎮]+|[台市區縣鄉鎮]+$', '', 'g') <> rest
  UNION ALL SELECT q, [], [], 3, q FROM pq),
pt AS (SELECT ord, dd.city_idx, dd.district_idx, {NORM.format(x="coalesce(point_name, '') || coalesce(village, '')")} AS hay, {NORM.format(x="coalesce(point_name, '') || coalesce(village, '') || p.district || '區'")} AS fh FROM v_points p JOIN dd ON dd.city_slug = p.city_slug AND dd.district_slug = p.district_slug),
hs AS (SELECT q, stage, ord, CASE WHEN needle = '' THEN 0 ELSE strpos(CASE WHEN len(districts) > 0 THEN hay ELSE fh END, needle) - 1 END AS score FROM nd, pt
  WHERE (len(cities) = 0 OR list_contains(cities, city_idx)) AND (len(districts) = 0 OR list_contains(districts, district_idx))),
h3 AS (SELECT *, min(stage) OVER (PARTITION BY q) AS best FROM hs WHERE score >= 0),
rk AS (SELECT q, stage, ord, score, stage < 3 AND len((SELECT any_value(cities) FROM pq WHERE pq.q = h3.q)) > 0 AS city_named, CAST(row_number() OVER (PARTITION BY q ORDER BY score, ord) AS INT) AS rank FROM h3 WHERE stage = best)
SELECT q, rank, ord, CAST(score AS INT) AS score, CAST(stage AS INT) AS stage, city_named FROM rk WHERE rank <= 20""")
def address_search(v):
    return S.address_search(asked(v), places(v))
