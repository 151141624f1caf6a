"""Queries of identifiers, snapshots and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from schedlake.operators import identity as I
from schedlake.operators import publish as P
from schedlake.operators import reconcile as R
from schedlake.operators.normalize import nest_schedules
from schedlake.bindings import KINDS
from schedlake.plans.registry import query
from schedlake.session import work_dir
from schedlake.sources import sinks


def identity_rows(v):
    """Identity columns of the points: three in seven without a plate, one in eight without a first arrival."""
    return v.points().select(
        "ord",
        "city_slug",
        "district_slug",
        I.base_key(F.col("village"), F.col("point_name")).alias("base_key"),
        F.when(F.col("ord") % 7 < 4, F.concat(F.lit("PL"), (F.col("ord") % 5).cast("string"))).alias("plate"),
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("R"), (F.col("ord") % 2).cast("string"))).alias("route_scope"),
        F.when(F.col("ord") % 8 != 0, F.format_string("%02d:%02d", (6 + F.col("ord") * 7 % 17).cast("int"), (F.col("ord") * 11 % 60).cast("int"))).alias("first_arrive"),
        F.upper(F.substring("city_slug", 1, 3)).alias("prefix"),
    )


def previous_slots(v):
    """An earlier id map: most points, with shifted times and a part of the plates changed."""
    old = identity_rows(v).filter("ord % 6 <> 1").withColumn("plate", F.when(F.col("ord") % 5 < 2, F.concat(F.col("plate"), F.lit("x"))).otherwise(F.col("plate")))
    old = old.withColumn("first_arrive", F.when(F.col("ord") % 9 == 0, F.lit(None)).otherwise(F.col("first_arrive")))
    return I.fresh_ids(old).select(*I.SLOT_COLUMNS)


@query("stable_ids_fast", "v_points", sql="""
WITH k AS (SELECT ord, city_slug, district_slug, coalesce(village, '') || '|' || coalesce(point_name, 'None') AS base_key FROM v_points),
n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY city_slug, district_slug, base_key ORDER BY ord) - 1 AS slot FROM k WINDOW w AS (PARTITION BY city_slug, district_slug, base_key))
SELECT ord, upper(substr(city_slug, 1, 3)) || '-' || upper(district_slug) || '-' || upper(substr(sha256(CASE WHEN n = 1 THEN base_key ELSE base_key || '#' || slot END), 1, 10)) AS point_id, CAST(slot AS INT) AS slot FROM n""")
def stable_ids_fast(v):
    return I.fresh_ids(identity_rows(v)).select("ord", "point_id", "slot")


MINUTE_SQL = "CAST(split_part({x}, ':', 1) AS INT) * 60 + CAST(split_part({x}, ':', 2) AS INT)"
#: Follows the greedy choices of round 2 row by row with a recursive query; the other rounds are ranks.
STABLE_SQL = f"""
WITH RECURSIVE k AS (
  SELECT ord, city_slug || '/' || district_slug || '/' || coalesce(village, '') || '|' || coalesce(point_name, 'None') AS g, coalesce(village, '') || '|' || coalesce(point_name, 'None') AS base_key,
    upper(substr(city_slug, 1, 3)) || '-' || upper(district_slug) || '-' AS prefix, CASE WHEN ord % 7 < 4 THEN 'PL' || ord % 5 END AS plate, CASE WHEN ord % 3 = 0 THEN 'R' || ord % 2 ELSE '' END AS scope,
    CASE WHEN ord % 8 <> 0 THEN lpad(CAST(6 + ord * 7 % 17 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ord * 11 % 60 AS VARCHAR), 2, '0') END AS arrive FROM v_points),
rw AS (SELECT *, {MINUTE_SQL.format(x='arrive')} AS minute FROM k),
od AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, CAST(row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS INT) AS slot FROM rw WHERE ord % 6 <> 1),
sl AS (SELECT g, slot, prefix || upper(substr(sha256(CASE WHEN n = 1 THEN base_key ELSE base_key || '#' || slot END), 1, 10)) AS point_id, CASE WHEN ord % 5 < 2 THEN plate || 'x' ELSE plate END AS plate, scope,
  CASE WHEN ord % 9 <> 0 THEN minute END AS minute FROM od),
ns AS (SELECT g, CAST(count(*) AS INT) AS slots FROM sl GROUP BY 1),
kn AS (SELECT rw.* FROM rw JOIN ns USING (g)),
p1 AS (SELECT ord, a.g, slot FROM (SELECT *, row_number() OVER (PARTITION BY g, plate ORDER BY ord) AS i FROM kn WHERE plate IS NOT NULL) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY g, plate ORDER BY slot) AS i FROM sl WHERE plate IS NOT NULL) b ON a.g = b.g AND a.plate = b.plate AND a.i = b.i),
r1 AS (SELECT * FROM kn WHERE ord NOT IN (SELECT ord FROM p1)),
s1 AS (SELECT * FROM sl WHERE (g, slot) NOT IN (SELECT (g, slot) FROM p1)),
ra AS (SELECT g, scope, list({{'o': ord, 'm': minute}} ORDER BY ord) AS rs FROM r1 WHERE minute IS NOT NULL GROUP BY 1, 2),
sa AS (SELECT g, scope, list({{'s': slot, 'm': minute}} ORDER BY slot) AS ss FROM s1 WHERE minute IS NOT NULL GROUP BY 1, 2),
gr(g, scope, i, rs, ss, ord, slot) AS (
  SELECT ra.g, ra.scope, 0, rs, ss, CAST(NULL AS BIGINT), CAST(NULL AS INT) FROM ra JOIN sa ON ra.g = sa.g AND ra.scope = sa.scope
  UNION ALL
  SELECT g, scope, i + 1, rs, list_filter(ss, lambda x: x.s <> pick.s), rs[i + 1].o, pick.s
  FROM (SELECT *, list_sort(list_transform(ss, lambda x: {{'d': abs(x.m - rs[i + 1].m), 's': x.s}}))[1] AS pick FROM gr WHERE i < len(rs) AND len(ss) > 0)),
p2 AS (SELECT ord, g, slot FROM gr WHERE ord IS NOT NULL),
p3 AS (SELECT a.ord, a.g, b.slot FROM (SELECT *, row_number() OVER (PARTITION BY g, scope ORDER BY ord) AS i FROM r1 WHERE ord NOT IN (SELECT ord FROM p2)) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY g, scope ORDER BY slot) AS i FROM s1 WHERE (g, slot) NOT IN (SELECT (g, slot) FROM p2)) b ON a.g = b.g AND a.scope = b.scope AND a.i = b.i),
pr AS (SELECT *, 'plate' AS how FROM p1 UNION ALL SELECT *, 'time' FROM p2 UNION ALL SELECT *, 'order' FROM p3),
mt AS (SELECT kn.*, CAST(slots + row_number() OVER (PARTITION BY kn.g ORDER BY ord) - 1 AS INT) AS slot FROM kn JOIN ns USING (g) WHERE ord NOT IN (SELECT ord FROM pr)),
fr AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, CAST(row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS INT) AS slot FROM rw WHERE g NOT IN (SELECT g FROM ns))
SELECT ord, point_id, pr.slot, how FROM pr JOIN sl ON sl.g = pr.g AND sl.slot = pr.slot
UNION ALL SELECT ord, prefix || upper(substr(sha256(base_key || '#' || slot), 1, 10)), slot, 'minted' FROM mt
UNION ALL SELECT ord, prefix || upper(substr(sha256(CASE WHEN n = 1 THEN base_key ELSE base_key || '#' || slot END), 1, 10)), slot, 'fresh' FROM fr"""


@query("stable_ids", "v_points", sql=STABLE_SQL)
def stable_ids(v):
    return I.assign_ids(identity_rows(v), previous_slots(v))[0].select("ord", "point_id", "slot", "how")


@query("collision_check", "v_points", sql="""
WITH k AS (SELECT city_slug, district_slug, coalesce(village, '') || '|' || coalesce(point_name, 'None') AS base_key FROM v_points),
i AS (SELECT DISTINCT city_slug, district_slug, base_key, upper(substr(sha256(base_key), 1, 1)) AS point_id FROM k)
SELECT city_slug, district_slug, point_id, min(base_key) AS first_key, max(base_key) AS last_key FROM i GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def collision_check(v):
    from schedlake.functions.text import content_id

    # one hex digit only, so that the check has collisions to find
    return I.collisions(identity_rows(v).withColumn("point_id", content_id(F.col("base_key"), 1)))


def snapshot(v, which):
    """Two versions of the points; names carry a number, so that groups of one and of several rows occur."""
    if which == "old":
        points, entries = v.points().filter("ord % 9 <> 0"), v.entries()
    else:
        points, entries = v.points().filter("ord % 11 <> 0"), v.entries().filter("seq % 50 <> 0")
    points = points.withColumn("point_name", F.concat("point_name", F.lit(" "), (F.col("ord") % 400).cast("string")))
    if which == "new":
        points = points.withColumn("point_id", F.concat("point_id", F.lit("N")))
    else:
        points = points.withColumn("point_id", F.when(F.col("ord") % 37 == 0, F.lit("X-1")).otherwise(F.col("point_id")))
    nested = nest_schedules(points, entries, KINDS, "ord")
    return nested.withColumn("sig", F.when(F.col("ord") % 800 < 400, R.schedule_signature("schedule", "recycling_schedule")).otherwise(F.lit("same")))


SNAPSHOT_CTE = """
WITH om AS (SELECT ord, kind, arrive, depart, weekday IS NULL AS u, coalesce(list_sort(list(DISTINCT weekday) FILTER (WHERE weekday IS NOT NULL)), []) AS days FROM v_entries WHERE kind <> 'foodscraps' GROUP BY ord, kind, arrive, depart, weekday IS NULL),
nm AS (SELECT ord, kind, arrive, depart, weekday IS NULL AS u, coalesce(list_sort(list(DISTINCT weekday) FILTER (WHERE weekday IS NOT NULL)), []) AS days FROM v_entries WHERE kind <> 'foodscraps' AND seq % 50 <> 0 GROUP BY ord, kind, arrive, depart, weekday IS NULL),
os AS (SELECT ord, string_agg(kind || array_to_string(days, ',') || '@' || arrive || coalesce(depart, ''), '|' ORDER BY kind, days, arrive, depart NULLS FIRST) AS s FROM om GROUP BY 1),
ns AS (SELECT ord, string_agg(kind || array_to_string(days, ',') || '@' || arrive || coalesce(depart, ''), '|' ORDER BY kind, days, arrive, depart NULLS FIRST) AS s FROM nm GROUP BY 1),
a AS (SELECT p.ord, coalesce(village, '') AS kv, coalesce(point_name || ' ' || p.ord % 400, '') AS kn, CASE WHEN p.ord % 37 = 0 THEN 'X-1' ELSE point_id END AS pid, CASE WHEN p.ord % 800 < 400 THEN coalesce(s, '') ELSE 'same' END AS sig FROM v_points p LEFT JOIN os ON os.ord = p.ord WHERE p.ord % 9 <> 0),
b AS (SELECT p.ord, coalesce(village, '') AS kv, coalesce(point_name || ' ' || p.ord % 400, '') AS kn, point_id || 'N' AS pid, CASE WHEN p.ord % 800 < 400 THEN coalesce(s, '') ELSE 'same' END AS sig FROM v_points p LEFT JOIN ns ON ns.ord = p.ord WHERE p.ord % 11 <> 0),
bs AS (SELECT kv, kn, sig, count(*) AS n, min(pid) AS pid FROM b GROUP BY 1, 2, 3), bg AS (SELECT kv, kn, count(*) AS n, min(pid) AS pid FROM b GROUP BY 1, 2),
j AS (SELECT a.*, count(*) OVER (PARTITION BY a.kv, a.kn) AS n_old, bg.n AS n_new, bg.pid AS only_id, bs.pid AS sig_id, bool_and(coalesce(bs.n = 1, FALSE)) OVER (PARTITION BY a.kv, a.kn) AS once
  FROM a LEFT JOIN bg ON bg.kv = a.kv AND bg.kn = a.kn LEFT JOIN bs ON bs.kv = a.kv AND bs.kn = a.kn AND bs.sig = a.sig),
r AS (SELECT ord, kv, kn, pid, CASE WHEN n_new IS NULL THEN 'unmatched' WHEN NOT ((n_old = 1 AND n_new = 1) OR (n_old = n_new AND once)) THEN 'ambiguous' WHEN pid = 'X-1' THEN 'unmatched' ELSE 'matched' END AS status,
  CASE WHEN n_old = 1 AND n_new = 1 THEN only_id ELSE sig_id END AS target FROM j)"""


def reconciled(v):
    return R.reconcile(snapshot(v, "old"), snapshot(v, "new"))


@query("snapshot_diff", "v_points v_entries", sql=SNAPSHOT_CTE + """
SELECT ord, status, CASE WHEN status = 'matched' THEN target END AS new_point_id FROM r""")
def snapshot_diff(v):
    return reconciled(v).select("ord", "status", "new_point_id")


@query("snapshot_stats", "v_points v_entries", sql=SNAPSHOT_CTE + """
SELECT count(*) AS old_total, count(*) FILTER (WHERE status = 'matched') AS matched_unique, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous_skipped,
  (SELECT count(*) FROM (SELECT DISTINCT kv, kn FROM r WHERE status = 'ambiguous')) AS ambiguous_groups, count(*) FILTER (WHERE status = 'unmatched') AS unmatched_no_key,
  round(count(*) FILTER (WHERE status = 'matched')::DOUBLE / count(*), 6) AS coverage_rate FROM r""")
def snapshot_stats(v):
    return R.reconcile_stats(reconciled(v)).withColumn("coverage_rate", F.round("coverage_rate", 6))


@query("snapshot_added_removed", "v_points", sql="""
SELECT ord, CASE WHEN ord % 9 = 0 THEN 'added' WHEN ord % 11 = 0 THEN 'removed' ELSE 'kept' END AS status FROM v_points WHERE ord % 99 <> 0""")
def snapshot_added_removed(v):
    return P.snapshot_changes(v.points().filter("ord % 9 <> 0"), v.points().filter("ord % 11 <> 0"), "ord")


@query("redirect_lookup", "v_points", sql="""
WITH t AS (SELECT city_slug, district_slug, CAST(ord AS VARCHAR) AS old_slug, point_id || '-N' AS new_point_id FROM v_points WHERE ord % 4 <> 0),
q AS (SELECT event_id, city_slug, district_slug, CAST(user_id AS VARCHAR) AS old_slug FROM events JOIN v_points ON ord = user_id)
SELECT event_id, new_point_id, CASE WHEN new_point_id IS NOT NULL THEN lower(split_part(new_point_id, '-', 2)) END AS new_district,
  CASE WHEN new_point_id IS NOT NULL THEN split_part(new_point_id, '-', 3) || '-N' END AS new_slug
FROM q LEFT JOIN t ON t.city_slug = q.city_slug AND t.district_slug = q.district_slug AND t.old_slug = q.old_slug""")
def redirect_lookup(v):
    table = v.points().filter("ord % 4 <> 0").select("city_slug", "district_slug", F.col("ord").cast("string").alias("old_slug"), F.concat("point_id", F.lit("-N")).alias("new_point_id"))
    places = v.points().select("ord", "city_slug", "district_slug")
    asked = v.table("events").select("event_id", F.col("user_id").alias("ord")).join(places, ["ord"], "inner")
    asked = asked.withColumn("old_slug", F.col("ord").cast("string"))
    return R.lookup_redirects(asked, table).select("event_id", "new_point_id", "new_district", "new_slug")


@query("point_lookup", "v_points", sql="""
WITH q AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'AFR-NATION' || (event_id % 40) || '-0' ELSE p.point_id END AS point_id FROM events LEFT JOIN v_points p ON p.ord = user_id),
dn AS (SELECT split_part(point_id, '-', 1) AS city_id, district_slug, min(district) AS district_name FROM v_points GROUP BY 1, 2)
SELECT event_id, q.point_id, p.point_name, p.point_id IS NOT NULL AS found, district_name FROM q LEFT JOIN v_points p ON p.point_id = q.point_id LEFT JOIN dn ON dn.city_id = split_part(q.point_id, '-', 1) AND dn.district_slug = lower(split_part(q.point_id, '-', 2))""")
def point_lookup(v):
    events = v.table("events").select("event_id", F.col("user_id").alias("ord"))
    asked = events.join(v.points().select("ord", "point_id"), ["ord"], "left")
    stale = F.concat(F.lit("AFR-NATION"), (F.col("event_id") % 40).cast("string"), F.lit("-0"))
    asked = asked.select("event_id", F.when(F.col("event_id") % 5 == 0, stale).otherwise(F.col("point_id")).alias("point_id"))
    return R.lookup_points(asked, v.points()).select("event_id", "point_id", "point_name", "found", "district_name")


@query("capped_list", sql="""
WITH f AS (SELECT user_id, event_id * 7 % 40 AS item, min(event_id) AS first_seen FROM events GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_seen, item) AS INT) AS position FROM f) SELECT * FROM r WHERE position <= 8""")
def capped_list(v):
    items = v.table("events").select("user_id", (F.col("event_id") * 7 % 40).alias("item"), "event_id")
    return R.capped_list(items, "user_id", "item", "event_id", 8)


@query("publish_replace", "v_points", sql="""
SELECT city_slug, district_slug, count(*) AS n, max(v) AS version FROM (
  SELECT city_slug, district_slug, 1 AS v FROM v_points WHERE city_slug NOT IN ('asia', 'europe')
  UNION ALL SELECT city_slug, district_slug, 2 FROM v_points WHERE city_slug IN ('asia', 'europe') AND ord % 5 <> 0) GROUP BY 1, 2""")
def publish_replace(v):
    current = v.points().withColumn("v", F.lit(1))
    fresh = v.points().filter("city_slug in ('asia', 'europe') and ord % 5 <> 0").withColumn("v", F.lit(2))
    return P.replace_partitions(current, fresh, "city_slug").groupBy("city_slug", "district_slug").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("version"))


@query("publish_written", "v_points v_entries", sql="""
WITH e AS (SELECT DISTINCT ord FROM v_entries),
c AS (SELECT p.* FROM v_points p JOIN e USING (ord) WHERE point_name IS NOT NULL),
t AS (SELECT city_slug, district_slug, 1 AS v FROM c WHERE city_slug NOT IN ('asia', 'europe') UNION ALL SELECT city_slug, district_slug, 2 FROM c WHERE city_slug IN ('asia', 'europe') AND ord % 5 <> 0)
SELECT city_slug, district_slug, count(*) AS n, max(v) AS version FROM t GROUP BY 1, 2""")
def publish_written(v):
    """Writes all publishable points, replaces two cities by a second version, and reads the table back."""
    path = f"{work_dir(v.spark)}/publish-{uuid.uuid4().hex}"
    arrays = ["schedule", "recycling_schedule", "foodscraps_schedule"]
    first = v.points_nested().withColumn("v", F.lit(1))
    sinks.write_points(sinks.publishable(first, arrays), path)
    second = first.filter("city_slug in ('asia', 'europe') and ord % 5 <> 0").withColumn("v", F.lit(2))
    sinks.write_points(sinks.publishable(second, arrays), path)
    return v.spark.read.parquet(path).groupBy("city_slug", "district_slug").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("version"))


@query("publish_stored", "v_points v_entries", sql="""
WITH n AS (SELECT city_slug, count(*) AS total FROM v_points GROUP BY 1),
n2 AS (SELECT city_slug, count(*) AS total FROM v_points WHERE city_slug IN ('asia', 'europe') AND ord % 10 <> 0 GROUP BY 1),
t AS (SELECT city_slug, 1 AS v FROM v_points WHERE city_slug NOT IN ('asia', 'europe') UNION ALL SELECT city_slug, 2 FROM v_points WHERE city_slug IN ('asia', 'europe') AND ord % 10 <> 0)
SELECT t.city_slug, count(*) AS n, max(v) AS version, any_value(coalesce(n2.total, n.total)) AS baseline, CASE WHEN any_value(n2.total) IS NULL THEN 't1' ELSE 't2' END AS updated_at
FROM t JOIN n USING (city_slug) LEFT JOIN n2 USING (city_slug) GROUP BY 1""")
def publish_stored(v):
    """Publishes all points with their baseline, then two cities again, stopped before their partitions are replaced and repaired,
    and reads both back. Names, coordinates and garbage entries are made complete for the gate."""
    path = f"{work_dir(v.spark)}/publish-{uuid.uuid4().hex}"
    arrays = ["schedule", "recycling_schedule", "foodscraps_schedule"]
    listed = lambda c: F.transform(c, lambda e: F.struct(e["weekday"], e["arrive"], e["depart"], F.lit("listed").alias("weekday_source")))
    always = F.expr("array(named_struct('weekday', array(1), 'arrive', '08:00', 'depart', cast(null as string), 'weekday_source', 'listed'))")
    points = v.points_nested().withColumns({a: listed(a) for a in arrays}).withColumns({"lat": F.lit(24.0), "lng": F.lit(121.0), "point_name": F.coalesce("point_name", F.lit("-"))})
    points = points.withColumn("schedule", F.when(F.size("schedule") > 0, F.col("schedule")).otherwise(always))
    sinks.publish_stored(points.withColumn("v", F.lit(1)), path, "city_slug", arrays, "t1")
    second = points.filter("city_slug in ('asia', 'europe') and ord % 10 <> 0").withColumn("v", F.lit(2))
    sinks.store_run(second, path, "city_slug", arrays, "t2")
    sinks.recover(v.spark, path, "city_slug")
    rows = v.spark.read.parquet(path).groupBy("city_slug").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("version"))
    known = sinks.stored_baseline(v.spark, path, "city_slug").select("city_slug", F.col("count").alias("baseline"), "updated_at")
    return rows.join(known, "city_slug")


@query("sitemap_rows", "v_points", sql="""
WITH p AS (SELECT *, split_part(point_id, '-', 3) AS rest, CASE WHEN length(fetched_at) = 10 THEN fetched_at || 'T00:00:00' ELSE strftime(CAST(fetched_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') END AS seen FROM v_points)
SELECT 'city' AS level, 'https://example.org/trash/' || city_slug || '/' AS loc, arg_max(fetched_at, seen || fetched_at) AS lastmod FROM p GROUP BY city_slug
UNION ALL SELECT 'district', 'https://example.org/trash/' || city_slug || '/' || district_slug || '/', arg_max(fetched_at, seen || fetched_at) FROM p GROUP BY city_slug, district_slug
UNION ALL SELECT 'point', 'https://example.org/trash/' || city_slug || '/' || district_slug || '/' || rest || '/', fetched_at FROM p""")
def sitemap_rows(v):
    return P.sitemap_rows(v.points(), "https://example.org/trash")
