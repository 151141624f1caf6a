"""Small helpers that several operators share: settled intermediate tables, text slices, words, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.session import cut_lineage

#: Fixed value: a word is a run of characters other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds; longer texts are held alone.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps neither recompute it nor depend on
    an executor that may be lost, and Spark knows its size. ``session.clear_work`` removes the tables."""
    return cut_lineage(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as it takes to differ from the columns of ``df``."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def row_name(*columns: str):
    """A 128-bit name of a row's values, never null: equal rows share it, in every scan, so no numbered copy is written."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("x"), F.xxhash64(F.lit(2), *columns).alias("y"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, settled, with a column that numbers the rows, and that column's name."""
    key = free_name(docs, "row_key")
    return settle(docs.withColumn(key, F.monotonically_increasing_id())), key


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice stay below ``limit`` bytes (a longer text comes alone)."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def whole_groups(parts: Iterator[pa.RecordBatch], key: str, full: int, size) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``, cut where ``size`` of the rows held reaches ``full``."""
    held: list[pa.RecordBatch] = []
    amount = 0
    for part in parts:
        held.append(part)
        amount += size(part)
        if amount < full:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(keys == keys[-1])[0])
        if last:
            yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            amount = sum(map(size, held))
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id of ``links`` (a, b: undirected links).

    Alternates large-star and small-star steps: every step is a grouped minimum and an equality join, each round is
    settled, and the number of rounds grows with the logarithm of the longest chain. No group is collected: a vertex with
    very many neighbours only meets them as rows. Returns (id, component) for every id that has a link.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = settle(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def spread_rank(df: DataFrame, keys: list[str], unique: str, name: str, bucket_rows: int = 1000) -> DataFrame:
    """Add a gapless 0-based rank per ``keys`` in an order that a hash of ``unique`` gives. Rows of a key are ranked in
    hash buckets, as many as the table has ``bucket_rows``; running sums over the buckets give each bucket's first rank.

    The number of buckets is one for all keys: nothing deals the rows by key alone, which would put a frequent key into
    one task and keep it there through the ranking. ``df`` is counted, so it should be a settled table.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(unique, F.lit(77)), F.lit(buckets)))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(unique)) - 1
    return placed.withColumn("__inside", inside).join(first, [*keys, "__bucket"]).withColumn(name, F.col("__first") + F.col("__inside")).drop("__first", "__inside", "__bucket")
