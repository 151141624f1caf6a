"""Writers. All of them write from the executors; nothing passes through the driver but one-row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.operators import quality
from schedlake.operators.normalize import has_entries, publish_reason, sanitize
from schedlake.operators.publish import baseline_upsert
from schedlake.session import cut_lineage, delete, exists


def write_points(points: DataFrame, path: str, by: str = "city_slug") -> None:
    """Replace exactly the partitions that occur in ``points``; others stay.

    Rows are dealt by ranges of (partition, district, id), so a large district fills several files, and sorted so that district
    lookups prune.
    """
    (
        points.repartitionByRange(by, "district_slug", "point_id")
        .sortWithinPartitions(by, "district_slug", "point_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )


def publishable(points: DataFrame, arrays: list[str]) -> DataFrame:
    """Rows that may be published, with their entries cleaned; the first array is required, the others become NULL when empty."""
    rows = points.filter(publish_reason(has_entries(*arrays)).isNull())
    return rows.withColumns({a: sanitize(F.col(a), required=i == 0) for i, a in enumerate(arrays)})


def publish(points: DataFrame, baseline: DataFrame, path: str, key: str, arrays: list[str], updated_at: str) -> tuple[DataFrame, DataFrame]:
    """Validate, then replace the partitions by their publishable rows. Raises before anything is written when a partition fails.

    The report, one row per partition, and the new baseline are stored before the write, so both stay readable
    when ``points`` or ``baseline`` come from the folder that is replaced. Returns (report, new baseline).
    """
    report = cut_lineage(quality.report(points, baseline, key, arrays))
    quality.gate(report, key)
    new_baseline = cut_lineage(baseline_upsert(baseline, report, key, updated_at))
    write_points(publishable(points, arrays), path, key)
    return report, new_baseline


def publish_passing(points: DataFrame, report: DataFrame, path: str, key: str, arrays: list[str]) -> None:
    """Replace only the partitions that pass, leaving failed ones on their old data."""
    write_points(publishable(points, arrays).join(report.filter("passed").select(key), key, "left_semi"), path, key)


def write_redirects(redirects: DataFrame, path: str, key: str = "city_slug") -> None:
    """Scoped replacement of the redirect table."""
    redirects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Store a table, such as the id map, as a new version beside the old ones; readers switch only when it is complete."""
    df.withColumn("version", F.lit(str(version))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Sorted CSV with a header, fixed column order and lower-case booleans (Spark writes them so)."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def write_index(points: DataFrame, cities: DataFrame, districts: DataFrame, path: str) -> None:
    """Search index: dictionaries and the dictionary-encoded points."""
    for name, part in (("cities", cities), ("districts", districts), ("points", points)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column, one line per row; used for sitemap elements."""
    df.select(column).write.mode("overwrite").text(path)


def write_events(events: DataFrame, path: str) -> None:
    """Calendar events, sorted by day, one event block per row."""
    block = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), "uid"),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), "dtstart"),
        F.concat(F.lit("DTEND;VALUE=DATE:"), "dtend"),
        F.concat(F.lit("SUMMARY:"), "summary"),
        F.concat(F.lit("DESCRIPTION:"), "description"),
        F.lit("END:VEVENT"),
    )
    events.orderBy("dtstart").select(block.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)


#: Folder beside the published partitions; Spark's readers skip names that begin with an underscore.
STATE = "_publish"
LOG = "run int, event string"


def _log(spark: SparkSession, path: str) -> dict[int, set[str]]:
    """Events by run: ``ready`` once rows and baseline of a run are stored, ``done`` once the partitions are replaced.

    One small row per publish."""
    if not exists(spark, f"{path}/{STATE}/log"):
        return {}
    rows = spark.read.schema(LOG).parquet(f"{path}/{STATE}/log").groupBy("run").agg(F.collect_set("event").alias("events")).collect()
    return {r["run"]: set(r["events"]) for r in rows}


def _note(spark: SparkSession, path: str, run: int, event: str) -> None:
    spark.range(1).select(F.lit(run).alias("run"), F.lit(event).alias("event")).coalesce(1).write.mode("append").parquet(f"{path}/{STATE}/log")


def _replay(spark: SparkSession, path: str, run: int, key: str) -> None:
    """Replace the partitions of a run by its stored rows. Doing so again changes nothing."""
    write_points(spark.read.parquet(f"{path}/{STATE}/run={run}/rows"), path, key)
    _note(spark, path, run, "done")


def stored_baseline(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Baseline of the last publish whose rows were stored, an empty one before the first."""
    ready = [run for run, events in _log(spark, path).items() if "ready" in events]
    if not ready:
        return spark.createDataFrame([], f"`{key}` string, count bigint, updated_at string")
    return spark.read.parquet(f"{path}/{STATE}/run={max(ready)}/baseline")


def recover(spark: SparkSession, path: str, key: str) -> list[int]:
    """Finish publishes that stopped between storing their rows and replacing the partitions, in their order. Returns their runs."""
    open_runs = sorted(run for run, events in _log(spark, path).items() if "ready" in events and "done" not in events)
    for run in open_runs:
        _replay(spark, path, run, key)
    return open_runs


def store_run(points: DataFrame, path: str, key: str, arrays: list[str], updated_at: str) -> tuple[int, DataFrame]:
    """Validate against the stored baseline and store the publishable rows and the new baseline as a run that is ready.

    Returns the run and the report. Raises before anything is stored when a partition fails.
    """
    spark = points.sparkSession
    baseline = stored_baseline(spark, path, key)
    report = cut_lineage(quality.report(points, baseline, key, arrays))
    quality.gate(report, key)
    run = max(_log(spark, path), default=0) + 1
    place = f"{path}/{STATE}/run={run}"
    publishable(points, arrays).write.mode("overwrite").parquet(f"{place}/rows")
    baseline_upsert(baseline, report, key, updated_at).write.mode("overwrite").parquet(f"{place}/baseline")
    _note(spark, path, run, "ready")
    return run, report


def publish_stored(points: DataFrame, path: str, key: str, arrays: list[str], updated_at: str) -> DataFrame:
    """Replace partitions and baseline together, the baseline being stored beside the data. Returns the report.

    Rows and baseline are stored first and become valid with one small append; only then the partitions are replaced. A run
    that stops before the append leaves nothing behind that counts; one that stops after it is finished by the next call
    (or ``recover``), so data and baseline never stay apart. One writer at a time.
    """
    spark = points.sparkSession
    recover(spark, path, key)
    run, report = store_run(points, path, key, arrays, updated_at)
    _replay(spark, path, run, key)
    return report


def drop_finished(spark: SparkSession, path: str) -> None:
    """Delete the stored rows of all finished runs but the last; their baselines are superseded too."""
    done = sorted(run for run, events in _log(spark, path).items() if "done" in events)
    for run in done[:-1]:
        delete(spark, f"{path}/{STATE}/run={run}")
