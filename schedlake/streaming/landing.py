"""Incremental jobs: landing new files once, and publishing what a run brings, complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from schedlake.session import shared_dir
from schedlake.sources.sinks import write_points

#: State of joined streams lies in RocksDB, one store for each shuffle partition instead of four, and a batch saves what it changed.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def _landed(stream: DataFrame, folder: str, checkpoint: str) -> list[int]:
    """Write every new micro-batch to its own ``batch=<id>`` folder and wait for the end. Rows of each batch.

    A batch that is repeated after a lost job overwrites its folder, so none is kept twice. Rows are
    counted while a batch is written, not taken from the progress list, which forgets old batches.
    """
    counts: dict[int, int] = {}

    def land(batch: DataFrame, number: int) -> None:
        seen = Observation(f"landed-{number}")
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        counts[number] = seen.get["n"]

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(counts.values())


def land_files(spark: SparkSession, source: str, schema: StructType | str, fmt: str, sink: str, checkpoint: str, glob: str | None = None) -> int:
    """Process the files that the checkpoint has not seen, then stop. Returns the number of new rows.

    Progress is kept in the checkpoint, so a rerun after a lost job neither skips nor repeats a file.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return sum(_landed(reader.load(source), sink, checkpoint))


def publish_stream(points: DataFrame, path: str, checkpoint: str, by: str = "city_slug") -> int:
    """Replace the partitions that occur in the rows a run brings. Returns the number of rows published.

    All micro-batches are landed first and the replacement is made from the landed rows, so a partition that is spread
    over several batches is replaced as a whole. Batches that were landed by a job that stopped before publishing are
    published by the next run.
    """
    spark = points.sparkSession
    folder, done = f"{checkpoint}/landed", f"{checkpoint}/published"
    _landed(points, folder, f"{checkpoint}/progress")
    spark.createDataFrame([(-1,)], "batch int").write.mode("overwrite").parquet(f"{done}/start")
    published = spark.read.option("recursiveFileLookup", "true").schema("batch int").parquet(done).agg(F.max("batch")).first()[0]
    landed = spark.read.schema(StructType([*points.schema.fields, StructField("batch", IntegerType())])).parquet(folder).filter(F.col("batch") > published)
    last = landed.agg(F.max("batch").alias("batch"), F.count(F.lit(1)).alias("n")).first()
    if last["n"]:
        write_points(landed.drop("batch"), path, by)
        spark.createDataFrame([(last["batch"],)], "batch int").write.mode("overwrite").parquet(f"{done}/upto={last['batch']}")
    return last["n"]


def land_changes(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, key: str, compare: list[str], version: str = "version") -> int:
    """Process the snapshot versions that the checkpoint has not seen, then stop. Returns the number of changes written to ``sink``.

    ``source`` holds one Parquet folder ``<version>=N`` per snapshot, N without gaps, each complete before the run that meets it.
    The sink gets (key, version, status): ``added`` (every key of the first version), ``removed``, or ``changed`` where a
    column of ``compare`` differs from the version before; kept keys are not written. Keys are unique in a version; rows
    without a key are left out. Files that join a version already judged are late and ignored; an empty version is judged with the next.

    Each version is joined with the version before it, which is the same stream moved on by one. The state store holds that
    version's keys and digests between runs, so earlier files are never read again; the watermark is the last version, and
    keys it leaves without a partner were added or removed. State lies on the executors' disks, not in their heaps. The number of
    shuffle partitions of the first run stays that of the checkpoint.
    """
    digest = F.md5(F.to_json(F.struct(*compare), {"ignoreNullFields": "false"})) if compare else F.lit("")

    def side(name: str, later: int) -> DataFrame:
        rows = spark.readStream.schema(schema).parquet(source).filter(F.col(key).isNotNull())
        moment = F.timestamp_seconds(F.col(version).cast("long") + later)
        return rows.select(F.col(key).alias(f"{name}_key"), moment.alias(f"{name}_at"), digest.alias(f"{name}_digest")).withWatermark(f"{name}_at", "0 seconds")

    both = side("new", 0).join(side("old", 1), F.expr("new_key = old_key AND new_at = old_at"), "full_outer")
    status = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("new_digest") != F.col("old_digest"), "changed")
    changes = both.select(
        F.coalesce("new_key", "old_key").alias(key), F.unix_seconds(F.coalesce("new_at", "old_at")).alias(version), status.alias("status"),
    ).filter("status IS NOT NULL")
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        return sum(_landed(changes, sink, checkpoint))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def landing_dirs(spark: SparkSession) -> tuple[str, str]:
    """Fresh (sink, checkpoint) folders below the shared folder."""
    base = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    return f"{base}/data", f"{base}/checkpoint"
