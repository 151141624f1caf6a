"""Queries of the district and city statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import maintained as M
from schedlake.operators import stats as S
from schedlake.plans.registry import query
from schedlake.session import cut_lineage

PER_POINT = """
pp AS (SELECT ord, count(*) AS n, coalesce(bit_or(CASE WHEN weekday IS NULL THEN 0 ELSE 1 << (weekday - 1) END), 0) AS mask, min(arrive) AS first, max(arrive) AS last
  FROM v_entries WHERE kind = 'garbage' GROUP BY 1),
rc AS (SELECT DISTINCT ord FROM v_entries WHERE kind = 'recycling'), fs AS (SELECT DISTINCT ord FROM v_entries WHERE kind = 'foodscraps'),
hh AS (SELECT city_slug, district_slug, h, count(e.ord) AS n FROM (SELECT DISTINCT city_slug, district_slug FROM v_points) k CROSS JOIN range(0, 24) r(h)
  LEFT JOIN (SELECT p.city_slug AS cs, p.district_slug AS ds, e.ord, CAST(substr(arrive, 1, 2) AS INT) AS hr FROM v_entries e JOIN v_points p ON p.ord = e.ord WHERE kind = 'garbage') e
  ON cs = city_slug AND ds = district_slug AND hr = h GROUP BY 1, 2, 3),
ht AS (SELECT city_slug, district_slug, string_agg(CAST(n AS VARCHAR), ',' ORDER BY h) AS hour_counts FROM hh GROUP BY 1, 2),
ds AS (SELECT city_slug, district_slug, any_value(district) AS district, count(*) AS point_count, count(DISTINCT village) AS village_count,
  """ + ", ".join(f"count(*) FILTER (WHERE (mask >> {w}) % 2 = 1) AS wd{w + 1}" for w in range(7)) + """,
  count(*) FILTER (WHERE n > 0 AND mask = 0) AS weekday_unknown_points, count(*) FILTER (WHERE n IS NULL) AS no_schedule_points,
  min(first) AS earliest_arrive, max(last) AS latest_arrive, count(rc.ord) AS recycling_points, count(fs.ord) AS foodscraps_points,
  CAST(floor(100.0 * count(rc.ord) / count(*) + 0.5) AS INT) AS recycling_pct, CAST(floor(100.0 * count(fs.ord) / count(*) + 0.5) AS INT) AS foodscraps_pct
  FROM v_points p LEFT JOIN pp ON pp.ord = p.ord LEFT JOIN rc ON rc.ord = p.ord LEFT JOIN fs ON fs.ord = p.ord GROUP BY 1, 2)"""


DISTRICT_STATS_SQL = f"""
WITH {PER_POINT.strip()}
SELECT city_slug, district_slug, point_count, village_count, wd1 || ',' || wd2 || ',' || wd3 || ',' || wd4 || ',' || wd5 || ',' || wd6 || ',' || wd7 AS weekday_counts,
  weekday_unknown_points, no_schedule_points, earliest_arrive, latest_arrive, hour_counts, recycling_points, recycling_pct, foodscraps_points, foodscraps_pct
FROM ds JOIN ht USING (city_slug, district_slug)"""


def joined_counts(out):
    for c in ("weekday_counts", "hour_counts"):
        out = out.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return out


@query("district_stats", "v_points v_entries", sql=DISTRICT_STATS_SQL)
def district_stats(v):
    return joined_counts(S.district_stats(v.points(), v.entries()))


@query("district_stats_maintained", "v_points v_entries", sql=DISTRICT_STATS_SQL)
def district_stats_maintained(v):
    """An earlier version of the points, in which a fifth had other villages and no entries and a ninth was missing, brought up to
    date by the changed points alone."""
    points, entries = v.points(), v.entries()
    other, missing = F.col("ord") % 5 == 0, F.col("ord") % 9 == 0
    before = points.filter(~missing).withColumn("village", F.when(other, F.lit("old")).otherwise(F.col("village")))
    state = cut_lineage(M.measures(before, entries.filter(~other)))
    removed = M.measures(before.filter(other), entries.filter("false"))
    added = M.measures(points.filter(other | missing), entries.filter(other | missing))
    return joined_counts(M.statistics(M.changed(state, added, removed)))


@query("weekday_counts", "v_points v_entries", sql="""
SELECT city_slug, district_slug, CAST(weekday AS INT) AS weekday, count(DISTINCT e.ord) AS points
FROM v_points p JOIN v_entries e ON e.ord = p.ord WHERE kind = 'garbage' AND weekday IS NOT NULL GROUP BY 1, 2, 3""")
def weekday_counts(v):
    return S.weekday_counts(v.points(), v.entries())


@query("hour_histogram", "v_points v_entries", sql="""
SELECT city_slug, district_slug, CAST(substr(arrive, 1, 2) AS INT) AS hour, count(*) AS entries
FROM v_points p JOIN v_entries e ON e.ord = p.ord WHERE kind = 'garbage' GROUP BY 1, 2, 3""")
def hour_histogram(v):
    return S.hour_histogram(v.points(), v.entries())


@query("peak_hours", "v_points v_entries", sql="""
WITH h AS (SELECT city_slug, district_slug, CAST(substr(arrive, 1, 2) AS INT) AS hour, count(*) AS n
  FROM v_points p JOIN v_entries e ON e.ord = p.ord WHERE kind = 'garbage' GROUP BY 1, 2, 3),
m AS (SELECT *, max(n) OVER (PARTITION BY city_slug, district_slug) AS peak FROM h),
t AS (SELECT city_slug, district_slug, peak, count(*) AS ties, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) AS hours FROM m WHERE n = peak GROUP BY 1, 2, 3)
SELECT city_slug, district_slug, CASE WHEN peak > 1 AND ties <= 3 THEN hours END AS hours, CASE WHEN peak > 1 AND ties <= 3 THEN peak END AS peak FROM t""")
def peak_hours(v):
    out = S.peak_hours(S.hour_histogram(v.points(), v.entries()))
    return out.withColumn("hours", F.array_join(F.col("hours").cast("array<string>"), ","))


@query("weekday_summary", "v_points v_entries", sql=f"""
WITH {PER_POINT.strip()},
w AS (SELECT city_slug, district_slug, unnest([1, 2, 3, 4, 5, 6, 7]) AS wd, unnest([wd1, wd2, wd3, wd4, wd5, wd6, wd7]) AS n FROM ds),
m AS (SELECT *, max(n) OVER (PARTITION BY city_slug, district_slug) AS top FROM w)
SELECT city_slug, district_slug, string_agg(CAST(wd AS VARCHAR), ',' ORDER BY wd) FILTER (WHERE top > 0 AND 2 * n >= top) AS normal_days,
  CASE WHEN any_value(top) > 0 THEN coalesce(string_agg(CAST(wd AS VARCHAR), ',' ORDER BY wd) FILTER (WHERE 2 * n < top AND n > 0), '') END AS low_days,
  CASE WHEN any_value(top) > 0 THEN coalesce(string_agg(CAST(wd AS VARCHAR), ',' ORDER BY wd) FILTER (WHERE 2 * n < top AND n = 0), '') END AS zero_days,
  min(n) FILTER (WHERE top > 0 AND 2 * n >= top) AS normal_min, max(n) FILTER (WHERE top > 0 AND 2 * n >= top) AS normal_max
FROM m GROUP BY 1, 2""")
def weekday_summary(v):
    out = S.weekday_summary(S.district_stats(v.points(), v.entries()))
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("normal_days", "low_days", "zero_days")]
    return out.select(*S.DISTRICT, *joined, "normal_min", "normal_max")


@query("district_groups", "v_points", sql="""
SELECT city_slug, lower(split_part(point_id, '-', 2)) AS slug, arg_min(district, ord) AS district, count(*) AS points FROM v_points GROUP BY 1, 2""")
def district_groups(v):
    return S.district_groups(v.points())


@query("village_groups", "v_points", sql="""
SELECT city_slug, district_slug, village, count(*) AS points FROM v_points WHERE village <> '' GROUP BY 1, 2, 3""")
def village_groups(v):
    return S.village_groups(v.points())


@query("date_range", "v_points", sql="""
SELECT city_slug, min(substr(fetched_at, 1, 10)) AS first_date, max(substr(fetched_at, 1, 10)) AS last_date FROM v_points GROUP BY 1""")
def date_range(v):
    return S.date_range(v.points(), ["city_slug"])


@query("city_stats", "v_points", sql="""
SELECT city_slug, count(DISTINCT district_slug) AS districts, count(*) AS points, 22 - (SELECT count(DISTINCT city_slug) FROM v_points) AS remaining_cities FROM v_points GROUP BY 1""")
def city_stats(v):
    return S.city_stats(v.points(), 22)


@query("time_table", "v_points v_entries", sql="""
SELECT p.ord, city_slug, district_slug, point_name, coalesce((SELECT min(arrive) FROM v_entries e WHERE e.ord = p.ord AND kind = 'garbage'), '99:99') AS first_arrive FROM v_points p""")
def time_table(v):
    return S.time_table(v.points(), v.entries())


@query("siblings", "v_points", sql="""
WITH d AS (SELECT DISTINCT city_slug, district_slug FROM v_points), a AS (SELECT city_slug, arg_min(district_slug, ord) AS district_slug FROM v_points GROUP BY 1)
SELECT a.city_slug, a.district_slug, d.district_slug AS sibling FROM a JOIN d ON a.city_slug = d.city_slug AND a.district_slug <> d.district_slug""")
def siblings(v):
    """Siblings of the district that each city's first point is in."""
    asked = v.points().groupBy("city_slug").agg(F.min_by("district_slug", "ord").alias("district_slug"))
    return S.siblings(asked, v.points(), "city_slug", "district_slug")


@query("children", "v_points", sql="""
SELECT city_slug, string_agg(DISTINCT district_slug, ',' ORDER BY district_slug) AS children FROM v_points GROUP BY 1""")
def children(v):
    return S.children(v.points(), "city_slug", "district_slug").withColumn("children", F.array_join("children", ","))


@query("first_per_key", "v_occasions", sql="""
SELECT deity_name, lunar_month, lunar_day, arg_min(common_name, ord) AS common_name, arg_min(occasion_type, ord) AS occasion_type FROM v_occasions GROUP BY 1, 2, 3""")
def first_per_key(v):
    return v.occasions().groupBy("deity_name", "lunar_month", "lunar_day").agg(
        F.min_by("common_name", "ord").alias("common_name"), F.min_by("occasion_type", "ord").alias("occasion_type")
    )
