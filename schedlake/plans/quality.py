"""Queries of the data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import normalize as N
from schedlake.operators import quality as Q
from schedlake.plans.normalising import GRID_CTE, REASON_SQL, classified, grid_binding
from schedlake.plans.registry import query
from schedlake.session import cut_lineage

ARRAYS = ["schedule", "recycling_schedule", "foodscraps_schedule"]


def tagged(v):
    """Points with tagged entries, some of them broken on purpose: bad times, contradicting tags."""

    def tag(c):
        return F.transform(
            F.col(c),
            lambda e: F.struct(
                F.when(e["arrive"] == "07:07", F.array(F.lit(9))).otherwise(e["weekday"]).alias("weekday"),
                F.when(F.substring(e["arrive"], 4, 2) == "33", F.concat(F.substring(e["arrive"], 1, 3), F.lit("73"))).otherwise(e["arrive"]).alias("arrive"),
                F.when(e["depart"] == "05:59", "5:59").otherwise(e["depart"]).alias("depart"),
                F.when(F.substring(e["arrive"], 4, 2) == "22", F.lit(None).cast("string"))
                .when(F.substring(e["arrive"], 4, 2) == "44", "absent")
                .when(F.size(e["weekday"]) > 0, "listed")
                .otherwise("absent")
                .alias("weekday_source"),
            ),
        )

    p = v.points_nested()
    for c in ARRAYS:
        p = p.withColumn(c, tag(c))
    return p


TAGGED_CTE = """
WITH te AS (SELECT ord, kind, CASE WHEN arrive = '07:07' THEN [9] ELSE days END AS days, CASE WHEN substr(arrive, 4, 2) = '33' THEN substr(arrive, 1, 3) || '73' ELSE arrive END AS arrive,
  CASE WHEN depart = '05:59' THEN '5:59' ELSE depart END AS depart,
  CASE WHEN substr(arrive, 4, 2) = '22' THEN 'unspecified' WHEN substr(arrive, 4, 2) = '44' THEN 'absent' WHEN len(days) > 0 THEN 'listed' ELSE 'absent' END AS src FROM v_merged),
tv AS (SELECT ord, (NOT regexp_matches(arrive, '^([01][0-9]|2[0-3]):[0-5][0-9]$'))::INT + coalesce((NOT regexp_matches(depart, '^([01][0-9]|2[0-3]):[0-5][0-9]$'))::INT, 0) AS bad_time,
  CASE WHEN src = 'absent' THEN len(days) > 0 ELSE len(days) = 0 OR len([d FOR d IN days IF d < 1 OR d > 7]) > 0 END AS bad_day, src FROM te),
l1 AS (SELECT city_slug, count(*) AS total, count(*) FILTER (WHERE coalesce(city, '') <> '' AND coalesce(district, '') <> '' AND coalesce(point_name, '') <> ''
  AND ord IN (SELECT ord FROM v_merged WHERE kind = 'garbage')) AS complete FROM v_points GROUP BY 1),
l2e AS (SELECT city_slug, sum(bad_time)::BIGINT AS time_violations, count(*) FILTER (WHERE bad_day) AS weekday_violations, count(*) FILTER (WHERE src = 'listed') AS listed,
  count(*) FILTER (WHERE src = 'absent') AS absent, count(*) FILTER (WHERE src = 'unspecified') AS unspecified FROM tv JOIN v_points USING (ord) GROUP BY 1),
l2c AS (SELECT city_slug, count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS coord_checked,
  count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat BETWEEN 21.5 AND 25.5 AND lng BETWEEN 119.5 AND 122.5)) AS coord_violations FROM v_points GROUP BY 1),
base AS (SELECT lower(replace(r_name, ' ', '')) AS city_slug, CASE WHEN r_regionkey = 2 THEN 0 ELSE 150 + 130 * r_regionkey END AS previous FROM region WHERE r_regionkey <> 4),
l3 AS (SELECT l1.city_slug, total, previous, CASE WHEN previous = 0 THEN 1.0::DOUBLE ELSE abs(total - previous)::DOUBLE / previous END AS rate FROM l1 LEFT JOIN base USING (city_slug))
"""


def baseline(v):
    return v.table("region").filter("r_regionkey <> 4").selectExpr(
        "lower(replace(r_name, ' ', '')) AS city_slug", "CASE WHEN r_regionkey = 2 THEN 0 ELSE 150 + 130 * r_regionkey END AS count", "r_name AS city", "'2026-01-01' AS updated_at"
    )


@query("dq_l1", "v_points v_merged", sql=TAGGED_CTE + """
SELECT city_slug, total, complete, round(complete::DOUBLE / total, 6) AS rate, complete::DOUBLE / total >= 0.95 AS passed FROM l1""")
def dq_l1(v):
    return Q.layer1(tagged(v), ["city_slug"]).withColumn("rate", F.round("rate", 6))


@query("dq_l2", "v_points v_merged", sql=TAGGED_CTE + """
SELECT city_slug, time_violations, weekday_violations, listed, absent, unspecified, coord_checked, coord_violations,
  round(coord_violations::DOUBLE / coord_checked, 6) AS rate, coord_violations::DOUBLE / coord_checked <= 0.05 AS passed FROM l2e JOIN l2c USING (city_slug)""")
def dq_l2(v):
    return Q.layer2(tagged(v), ["city_slug"], ARRAYS).withColumn("rate", F.round("rate", 6))


@query("dq_l3", "v_points v_merged", sql=TAGGED_CTE + """
SELECT city_slug, total, CAST(previous AS INT) AS previous, round(rate, 6) AS rate, CASE WHEN previous IS NULL THEN 'no baseline' END AS note, coalesce(rate <= 0.30, TRUE) AS passed FROM l3""")
def dq_l3(v):
    counts = v.points().groupBy("city_slug").agg(F.count(F.lit(1)).alias("total"))
    return Q.layer3(counts, baseline(v), "city_slug").withColumn("rate", F.round("rate", 6))


@query("dq_report", "v_points v_merged", sql=TAGGED_CTE + """
SELECT city_slug, l1.total, round(complete::DOUBLE / l1.total, 6) AS l1_rate, complete::DOUBLE / l1.total >= 0.95 AS l1_passed,
  round(coord_violations::DOUBLE / coord_checked, 6) AS l2_rate, coord_violations::DOUBLE / coord_checked <= 0.05 AS l2_passed,
  round(l3.rate, 6) AS l3_rate, coalesce(l3.rate <= 0.30, TRUE) AS l3_passed,
  complete::DOUBLE / l1.total >= 0.95 AND coord_violations::DOUBLE / coord_checked <= 0.05 AND coalesce(l3.rate <= 0.30, TRUE) AS passed
FROM l1 JOIN l2c USING (city_slug) JOIN l3 USING (city_slug)""")
def dq_report(v):
    out = Q.report(tagged(v), baseline(v), "city_slug", ARRAYS)
    for c in ("l1_rate", "l2_rate", "l3_rate"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("baseline_upsert", "v_points v_merged", sql=TAGGED_CTE + """,
ok AS (SELECT city_slug, l1.total FROM l1 JOIN l2c USING (city_slug) JOIN l3 USING (city_slug) WHERE complete::DOUBLE / l1.total >= 0.5 AND coalesce(l3.rate <= 0.30, TRUE))
SELECT coalesce(ok.city_slug, b.city_slug) AS city_slug, coalesce(ok.total, b.previous) AS count, CASE WHEN ok.total IS NULL THEN '2026-01-01' ELSE '2026-12-01' END AS updated_at
FROM ok FULL JOIN base b ON b.city_slug = ok.city_slug""")
def baseline_upsert(v):
    from schedlake.operators.publish import baseline_upsert as upsert

    report = Q.report(tagged(v), baseline(v), "city_slug", ARRAYS)
    # the test coordinates never pass layer 2, so the update is gated here by layers 1 (at one half) and 3
    report = report.withColumn("passed", (F.col("l1_rate") >= 0.5) & F.col("l3_passed"))
    return upsert(baseline(v).select("city_slug", "count", "updated_at"), report, "city_slug", "2026-12-01")


@query("weekday_source", "v_entries v_points", sql="""
SELECT city_slug, CASE WHEN weekday IS NULL THEN 'absent' WHEN seq % 17 = 0 THEN 'unspecified' ELSE 'listed' END AS weekday_source, count(*) AS n,
  round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY city_slug), 6) AS rate
FROM v_entries JOIN v_points USING (ord) GROUP BY 1, 2""")
def weekday_source(v):
    tag = F.when(F.col("weekday").isNull(), "absent").when(F.col("seq") % 17 != 0, "listed")
    entries = v.entries().join(v.points().select("ord", "city_slug"), ["ord"], "inner")
    return Q.weekday_source(entries.withColumn("weekday_source", tag), ["city_slug"]).withColumn("rate", F.round("rate", 6))


@query("publish_report", "v_points v_entries", sql=f"""
WITH c AS (SELECT city_slug, {REASON_SQL} AS reason FROM v_points)
SELECT city_slug, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS publishable, count(reason) AS filtered, count(*) FILTER (WHERE reason = 'missing_district') AS missing_district,
  count(*) FILTER (WHERE reason = 'missing_point_name') AS missing_point_name, count(*) FILTER (WHERE reason = 'empty_schedule_and_recycling') AS empty_schedule_and_recycling FROM c GROUP BY 1""")
def publish_report(v):
    return Q.publish_report(classified(v), ["city_slug"])


@query("drop_report", sql=GRID_CTE + """
SELECT c_nationkey AS district, count(*) AS total, count(*) FILTER (WHERE drop_reason IS NULL) AS valid,
  count(*) FILTER (WHERE drop_reason = 'wrong_col_count') AS wrong_col_count, count(*) FILTER (WHERE drop_reason = 'cell_pattern_fail') AS cell_pattern_fail,
  count(*) FILTER (WHERE drop_reason = 'empty_point_name') AS empty_point_name, count(*) FILTER (WHERE drop_reason = 'unknown_collection_type') AS unknown_collection_type
FROM rows_ GROUP BY ROLLUP (c_nationkey)""")
def drop_report(v):
    return Q.drop_report(N.grid_rows(grid_binding(v)), "district")


@query("download_dates", sql="""
SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS dates, count(DISTINCT CAST(o_orderdate AS DATE)) > 1 AS mixed FROM orders""")
def download_dates(v):
    return Q.download_dates(v.table("orders").select(F.to_date("o_orderdate").alias("d")), "d")


@query("multi_parent", "v_routes", sql="""
SELECT poi_id, count(DISTINCT route_id) AS parents FROM v_routes GROUP BY 1 HAVING count(DISTINCT route_id) > 1""")
def multi_parent(v):
    return Q.multi_parent(v.routes(), "poi_id", "route_id", expected=v.table("lineitem").count())


@query("dup_check", "v_foreign", sql="""
SELECT country, CAST(d AS VARCHAR) AS d, count(*) AS n FROM v_foreign GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_check(v):
    return Q.duplicates(v.foreign(), ["country", "d"]).withColumn("d", F.col("d").cast("string"))


@query("whitelist_check", "v_calendar", sql="""
SELECT memo AS value, count(*) AS n FROM v_calendar WHERE memo NOT IN ('', 'H1', 'H2', 'H3') GROUP BY 1""")
def whitelist_check(v):
    allowed = v.calendar().filter(F.col("memo").isin("", "H1", "H2", "H3")).select("memo")
    return Q.whitelist(v.calendar(), "memo", allowed)


@query("ref_check", "v_entries v_points", sql="""
WITH a AS (SELECT DISTINCT ord FROM v_entries WHERE ord % 5 <> 0), b AS (SELECT ord FROM v_points WHERE ord % 3 <> 0)
SELECT ord, 'missing' AS problem FROM a WHERE ord NOT IN (SELECT ord FROM b) UNION ALL SELECT ord, 'stale' FROM b WHERE ord NOT IN (SELECT ord FROM a)""")
def ref_check(v):
    return Q.reference_check(v.entries().filter("ord % 5 <> 0"), v.points().filter("ord % 3 <> 0"), ["ord"])


@query("date_gaps", "v_calendar_gaps", sql="""
WITH n AS (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM v_calendar_gaps)
SELECT CAST(d AS VARCHAR) AS after, CAST(nx AS VARCHAR) AS before, CAST(datediff('day', d, nx) - 1 AS INT) AS missing_days FROM n WHERE datediff('day', d, nx) > 1""")
def date_gaps(v):
    out = Q.date_gaps(v.calendar(gaps=True), "d", F.year("d"))
    return out.withColumn("after", F.col("after").cast("string")).withColumn("before", F.col("before").cast("string"))


@query("normalize_stats", "v_stops", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY route_id, poi_id, car_type ORDER BY l_orderkey * 10 + l_linenumber DESC, bare DESC, show_time DESC, memo_time DESC) AS rn FROM v_stops),
l AS (SELECT *, row_number() OVER () AS rid FROM r WHERE rn = 1),
ln AS (SELECT rid, 1 AS src, unnest(string_split(show_time, chr(10))) AS line, len(string_split(show_time, chr(10))) AS n, bare FROM l WHERE show_time <> ''
  UNION ALL SELECT rid, 2, unnest(string_split(memo_time, chr(10))), 99, bare FROM l WHERE memo_time <> ''),
c AS (SELECT *, regexp_matches(line, '^班表時間：[0-9]{1,2}:[0-9]{2}$') AS t0, regexp_matches(line, '^星期[一二三四五六日,]+：[0-9]{1,2}:[0-9]{2}$') AS t1 FROM ln),
e AS (SELECT rid, count(*) FILTER (WHERE t1) AS listed, count(*) FILTER (WHERE t0 OR (NOT t1 AND n = 1)) AS absent, count(*) FILTER (WHERE NOT t0 AND NOT t1) AS drops,
  count(*) FILTER (WHERE src = 2 AND (t0 OR t1)) AS memo,
  bool_or(CASE WHEN t0 THEN replace(line, '班表時間：', '') = bare WHEN t1 THEN split_part(line, '：', 2) = bare WHEN n = 1 THEN TRUE ELSE FALSE END) AS hit FROM c GROUP BY 1),
s AS (SELECT l.*, coalesce(listed, 0) AS listed, coalesce(absent, 0) AS absent, coalesce(drops, 0) AS drops, coalesce(memo, 0) AS memo,
  (coalesce(listed, 0) + coalesce(absent, 0) > 0 AND NOT coalesce(hit, FALSE)) AS mm FROM l LEFT JOIN e USING (rid)),
u AS (SELECT route_id, poi_id, s_suppkey IS NOT NULL AS kept,
  coalesce(sum(listed) FILTER (WHERE car_type = 'lagi'), 0) AS gl, coalesce(sum(absent) FILTER (WHERE car_type = 'lagi'), 0) AS ga,
  coalesce(sum(listed) FILTER (WHERE car_type = 'recycle'), 0) AS rl, coalesce(sum(absent) FILTER (WHERE car_type = 'recycle'), 0) AS ra,
  coalesce(sum(drops) FILTER (WHERE car_type = 'lagi'), 0) AS gd, coalesce(sum(drops) FILTER (WHERE car_type = 'recycle'), 0) AS rd,
  coalesce(sum(memo) FILTER (WHERE car_type = 'lagi'), 0) AS gm, coalesce(sum(memo) FILTER (WHERE car_type = 'recycle'), 0) AS rm, sum(mm::INT) AS mm
  FROM s LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) ON s_suppkey = route_id GROUP BY 1, 2, 3)
SELECT count(*) AS union_total, count(*) FILTER (WHERE NOT kept) AS dropped_missing_district, count(*) FILTER (WHERE kept AND gl + ga + rl + ra = 0) AS dropped_empty_both,
  count(*) FILTER (WHERE kept AND gl + ga = 0 AND rl + ra > 0) AS recycle_only_points,
  (sum(gd) FILTER (WHERE kept))::BIGINT AS schedule_line_drops, (sum(rd) FILTER (WHERE kept))::BIGINT AS recycling_line_drops,
  (sum(gm) FILTER (WHERE kept))::BIGINT AS schedule_memo_added, (sum(rm) FILTER (WHERE kept))::BIGINT AS recycling_memo_added,
  (sum(gl) FILTER (WHERE kept))::BIGINT AS schedule_listed, (sum(ga) FILTER (WHERE kept))::BIGINT AS schedule_absent,
  (sum(rl) FILTER (WHERE kept))::BIGINT AS recycling_listed, (sum(ra) FILTER (WHERE kept))::BIGINT AS recycling_absent,
  count(*) FILTER (WHERE kept AND rl + ra > 0) AS has_recycling, (sum(mm) FILTER (WHERE kept))::BIGINT AS arrive_mismatch,
  count(*) FILTER (WHERE kept AND gl + ga + rl + ra > 0) AS final_count,
  (SELECT count(*) FROM (SELECT poi_id FROM v_stops GROUP BY 1 HAVING count(DISTINCT route_id) > 1)) AS multi_route_pois FROM u""")
def normalize_stats(v):
    fields = ["bare", "show_time", "memo_time"]
    stops = v.stops().withColumn("file", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), *fields))
    last = stops.groupBy("route_id", "poi_id", "car_type").agg(F.max_by(F.struct(*fields), "file").alias("row")).select("route_id", "poi_id", "car_type", "row.*")
    parsed = N.text_timetable(last, "show_time", "memo_time", "bare")
    row = F.struct("entries", "drops", "memo_entries", "mismatch")
    side = lambda t: F.any_value(F.when(F.col("car_type") == t, row), ignoreNulls=True)
    united = parsed.groupBy("route_id", "poi_id").agg(side("lagi").alias("g"), side("recycle").alias("r"))
    served = v.table("supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("route_id"), F.col("s_nationkey").alias("district"))
    both = N.dim_map(united, served, "route_id").select(
        "poi_id", "route_id", "district",
        F.col("g.entries").alias("schedule"), F.col("r.entries").alias("recycling"), F.col("g.drops").alias("schedule_drops"), F.col("r.drops").alias("recycling_drops"),
        F.col("g.memo_entries").alias("schedule_memo"), F.col("r.memo_entries").alias("recycling_memo"),
        (F.coalesce(F.col("g.mismatch").cast("int"), F.lit(0)) + F.coalesce(F.col("r.mismatch").cast("int"), F.lit(0))).alias("mismatches"),
    )
    # read by the counters and by the count of points on several routes
    both = cut_lineage(both)
    shared = Q.multi_parent(both, "poi_id", "route_id").agg(F.count(F.lit(1))).scalar()
    return Q.normalize_stats(both, []).withColumn("multi_route_pois", shared)


@query("sort_check", sql="""
WITH r AS (SELECT o_orderkey, o_orderdate, max(o_orderdate) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM orders)
SELECT o_orderkey FROM r WHERE o_orderdate < top""")
def sort_check(v):
    return Q.unsorted(v.table("orders").select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate").select("o_orderkey")
