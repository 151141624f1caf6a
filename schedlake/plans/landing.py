"""Query of the incremental landing."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.plans.registry import query
from schedlake.streaming.landing import land_changes, land_files, landing_dirs


@query("incremental_landing", sql="""
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, min(event_id) AS first_event, 0 AS rows_of_second_run FROM events GROUP BY 1""")
def incremental_landing(v):
    """Lands the events twice; the second run finds nothing new."""
    schema = v.table("events").schema
    sink, checkpoint = landing_dirs(v.spark)
    land_files(v.spark, v.sf_dir, schema, "parquet", sink, checkpoint, "events.parquet")
    again = land_files(v.spark, v.sf_dir, schema, "parquet", sink, checkpoint, "events.parquet")
    return (
        v.spark.read.parquet(sink)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"), F.min("event_id").alias("first_event"), F.lit(again).alias("rows_of_second_run"))
    )


@query("snapshot_change_stream", "v_points", sql="""
WITH s AS (
  SELECT ord, CAST(1 AS BIGINT) AS version, point_name AS label FROM v_points WHERE ord % 9 <> 0
  UNION ALL SELECT ord, 2, CASE WHEN ord % 7 = 0 THEN 'moved' ELSE point_name END FROM v_points WHERE ord % 11 <> 0
  UNION ALL SELECT ord, 3, point_name FROM v_points WHERE ord % 5 <> 0),
j AS (
  SELECT coalesce(n.ord, o.ord) AS ord, coalesce(n.version, o.version + 1) AS version,
    CASE WHEN o.ord IS NULL THEN 'added' WHEN n.ord IS NULL THEN 'removed' WHEN n.label IS DISTINCT FROM o.label THEN 'changed' END AS status
  FROM s n FULL JOIN s o ON n.ord = o.ord AND n.version = o.version + 1)
SELECT ord, version, status FROM j WHERE status IS NOT NULL AND version <= 3""")
def snapshot_change_stream(v):
    """Three snapshots of the points, the first two met by one run, the third by the next, from state alone."""
    sink, checkpoint = landing_dirs(v.spark)
    source = f"{checkpoint}-versions"
    moved = F.when(F.col("ord") % 7 == 0, "moved").otherwise(F.col("point_name"))
    points = v.points().select("ord", "point_name")
    schema = points.withColumn("version", F.lit(1).cast("long")).schema
    snapshots = [points.filter("ord % 9 <> 0"), points.filter("ord % 11 <> 0").withColumn("point_name", moved), points.filter("ord % 5 <> 0")]
    for number, rows in enumerate(snapshots, start=1):
        rows.write.parquet(f"{source}/version={number}")
        if number > 1:
            land_changes(v.spark, source, schema, sink, checkpoint, "ord", ["point_name"])
    return v.spark.read.schema("ord long, version long, status string").parquet(sink).select("ord", "version", "status")
