"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. AQE splits skewed join partitions and merges small partitions; it starts from
#: ``initialPartitionNum`` shuffle partitions, which on a cluster must be large, as AQE never adds any elsewhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
#: Shuffle partitions that AQE starts from on a cluster.
CLUSTER_PARTITIONS = 8192


def build_session(app: str = "schedlake", master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS. ``shuffle_partitions`` defaults to 8 on a local master; elsewhere AQE starts from CLUSTER_PARTITIONS."""
    builder = SparkSession.builder.appName(app)
    settings = dict(SETTINGS)
    if master:
        builder = builder.master(master)
    if shuffle_partitions or (master or "").startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    else:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(CLUSTER_PARTITIONS)
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context, from wherever the driver runs it."""
    sc = spark.sparkContext
    if getattr(sc, "_schedlake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='schedlake-zip-')}/schedlake", "zip", root_dir=root.parent, base_dir=root.name)
    sc.addPyFile(archive)  # Spark's own file server hands it to the executors
    sc._schedlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session on a local master may leave it unset, as tests
    do; it then gets a temporary folder, since driver and executors are one process there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="schedlake-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables below the shared folder."""
    return f"{shared_dir(spark)}/schedlake-{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor costs no recomputation, later steps
    read only the columns they need, and Spark knows the size when it plans joins. ``clear_work`` removes the tables."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def clear_work(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no result that reads them is needed any more."""
    delete(spark, work_dir(spark))
