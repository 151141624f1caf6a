"""Operator 3: exact dedup with counting quotient filters.

Each partition fingerprints its texts (A-Z lower-cased, 64 bits of SHA-256) and builds a counting quotient filter: the
leading bits of a fingerprint are its quotient, the rest its remainder; per quotient the remainders lie sorted with their
counts. Filters of all partitions merge per quotient by their sorted remainders without loss. Copies inside a partition
are already one remainder with a count, so a group of any size adds one entry per partition. Fingerprints whose merged
count is above one send their documents to byte verification, a partial aggregation over the whole normalised text.

Null texts count as empty; empty texts are equal to each other. Rows whose id is null are grouped like any other, but
never become the row that stays unless no id of the group is known. Rows that repeat id and text count each. Only the id
and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle, text_bytes, text_slices

#: Fingerprints that share a quotient, on average.
RUN_LENGTH = 1024


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        shas = [hashlib.sha256(b.lower()).digest() for b in text_bytes(part)]  # bytes.lower() changes A-Z only
        fps = np.frombuffer(b"".join(s[:8] for s in shas), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.hex() for s in shas]), pa.array(fps)], ["doc_id", "text_sha256", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, fp) per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, text_sha256 string, fp bigint")


def quotient_filters(fps: DataFrame, quotient_bits: int) -> DataFrame:
    """One counting quotient filter per partition, a row per used quotient: remainders sorted, with their counts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        quotients = (values >> np.uint64(64 - quotient_bits)).astype(np.int64) if quotient_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.diff(quotients, prepend=-1))
        ends = [*cuts[1:], len(values)]
        mask = np.uint64((1 << (64 - quotient_bits)) - 1)
        for at in range(0, len(cuts), 1000):
            spans = list(zip(cuts[at : at + 1000], ends[at : at + 1000]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(quotients[cuts[at : at + 1000]]),
                    pa.array([(values[a:b] & mask).tobytes() for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in spans], pa.binary()),
                ],
                ["quotient", "remainders", "counts"],
            )

    return fps.select("fp").mapInArrow(build, "quotient bigint, remainders binary, counts binary")


def repeated_fingerprints(filters: DataFrame, quotient_bits: int) -> DataFrame:
    """Merge the filters by quotient and return the fingerprints with a count above one: (fp, n)."""

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        remainders = np.frombuffer(b"".join(runs.column("remainders").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(runs.column("counts").to_pylist()), np.int64)
        order = np.argsort(remainders, kind="stable")  # the parts are sorted already; a stable sort merges such runs
        remainders, counts = remainders[order], counts[order]
        cuts = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]]))
        total = np.add.reduceat(counts, cuts)
        high = np.uint64(key[0].as_py() << (64 - quotient_bits)) if quotient_bits else np.uint64(0)
        found = (remainders[cuts] | high)[total > 1]
        return pa.table({"fp": pa.array(found.view(np.int64)), "n": pa.array(total[total > 1])})

    return filters.groupBy("quotient").applyInArrow(merge, "fp bigint, n bigint")


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b.lower() for b in text_bytes(part)], pa.binary())], ["doc_id", "norm"])


def verified_groups(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Groups of byte-equal normalised texts among the documents in ``ids``: (text_sha256, group_size, keep_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(ids.select(F.col("doc_id").alias("__id")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    groups = texts.mapInArrow(_normalised, f"doc_id {kind}, norm binary").groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return groups.select(F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    light = settle(fingerprints(docs))
    rows = light.count()
    bits = max(0, math.ceil(math.log2(max(1, rows / RUN_LENGTH))))
    repeated = settle(repeated_fingerprints(quotient_filters(light, bits), bits))
    ids = light.join(repeated, "fp", "left_semi").select("doc_id")
    groups = settle(verified_groups(docs, ids))
    joined = light.drop("fp").join(groups, "text_sha256", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
