"""Operator 5: quality classifier by Bradley-Terry pairwise ranking.

Features of each whole text are taken in one pass. From a bounded sample of labelled rows (``SAMPLE``), pairs of a better
and a worse document are drawn; the weights of a linear score minimise the logistic loss of the feature differences, the
Bradley-Terry model. The cut is the score quantile at the share of worse documents in the sample, and a slope fitted on
the sample turns the distance from the cut into a number from 0 to 1, with the cut at ``CUT``.

Null and empty texts have all features zero and get a score like any other text. Labels that are null, or whose document
is missing, teach nothing; a document with several labels teaches each. If only one label (or none) is known there are no
pairs, and every score is 0.5. Only the id and the text column are read, and doc_id and label of the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schedlake.llm.common import documents, settle, text_bytes, text_slices

#: Labelled rows that the weights are fitted on, and pairs drawn from them. Both stay on the driver.
SAMPLE, PAIRS = 20_000, 100_000
#: Added to the length in shares, so that one capital or stop in a text of a word or two is not a large share.
FEW_BYTES, FEW_WORDS = 20, 3
#: Scores from here on are predicted as label 1.
CUT = 0.3
#: The byte classes whose share of a text is a feature. Digits are none: numbers do not make a text bad.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "blank": b" ",
    "line": b"\n",
    "other_space": b"\t\r\x0b\x0c",
    "stop": b".,;:",
    "loud": b"!?",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "bar": b"|",
    "symbol": b"#$%&*@^~",
    "code": b"+=_/\\",
    "dash": b"-",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "high": bytes(range(128, 256)),
}
SHAPES = ["word_length", "distinct_words", "repeated_next", "repeated_after_next", "one_byte_words", "long_words", "marked_words", "repeated_lines", "log_words"]
FEATURES = [*CLASSES, *SHAPES]
_BY_BYTE = np.array([[b in set(members) for members in CLASSES.values()] for b in range(256)], dtype=np.float64)


def features(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BY_BYTE / (len(text) + FEW_BYTES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    alnum = sum(map(bytes.isalnum, words)) if len(text) == len(text.decode("utf-8", "replace")) else sum(w[-1:].isalnum() or w[-1] > 127 or w[-1] in b".,;:" for w in words)
    return [
        *shares.tolist(),
        float(lengths.mean()) / 10 if len(words) else 0.0,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / (n + FEW_WORDS),
        sum(map(eq, words, words[2:])) / (n + FEW_WORDS),
        float((lengths == 1).sum()) / (n + FEW_WORDS),
        float((lengths > 24).sum()) / (n + FEW_WORDS),
        (n - alnum) / (n + FEW_WORDS),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words))) / 10,
    ]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        rows = [features(b) for b in text_bytes(part)]
        names = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(rows, pa.list_(pa.float64()))], [*names, "x"])


def document_features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, x array<double>) with the values of FEATURES, behind the columns ``keep``."""
    read = docs.select(*keep, "doc_id", "text")
    return read.mapInArrow(_run, T.StructType([*read.drop("text").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def held_out(doc_id: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def usual_range(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest usual value of each feature: beyond them a very short or odd text counts like the last usual one."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    return np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of the scaled score: sigmoid(x @ weights + offset) is CUT at the quantile."""
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return np.zeros(x.shape[1]), 0.0
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the logistic loss of the differences, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (1 - p) / pairs - 1e-2 * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w /= spread
    s = x @ w
    order, k = np.sort(s), len(worse)
    cut = (order[k - 1] + order[k]) / 2 if k < len(order) else order[-1]
    slope, level = 1.0, np.log(CUT / (1 - CUT))
    for _ in range(50):  # one number: the slope of the logistic curve through the cut
        p = 1 / (1 + np.exp(-np.clip(slope * (s - cut) + level, -40, 40)))
        g = ((y - p) * (s - cut)).mean() - 1e-3 * slope
        h = (p * (1 - p) * (s - cut) ** 2).mean() + 1e-3
        slope = max(0.05, slope + np.clip(g / h, -1, 1))
    return w * slope, float(level - cut * slope)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, doc_id, held_out, score, predicted."""
    all_x = settle(document_features(docs, keep))
    teach = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    chosen = teach.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # at most ``sample`` rows of two numbers are broadcast; of rows that repeat a labelled id, one teaches
    rows = all_x.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    low, high = usual_range(x)
    weights, offset = fit(np.clip(x, low, high), rows["y"].to_numpy())
    total = F.lit(offset)
    for i, w in enumerate(weights):
        total = total + F.greatest(F.least(F.col("x")[i], F.lit(float(high[i]))), F.lit(float(low[i]))) * float(w)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0)))) if weights.any() else F.lit(0.5)
    return all_x.select(*keep, "doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
