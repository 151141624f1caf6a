"""Operator 9: language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters; every run of other characters is one blank. For each language the counts of character
4-grams are summed in Spark over a bounded sample of documents (``PER_LANGUAGE`` each), and the lower orders follow from
them as continuation counts. A model is two sorted arrays of 64-bit hashes per order: n-grams with their discounted
share, contexts with the weight of the next lower order. A text's language has the lowest cross-entropy per character.

The best cross-entropy of sample documents that were not counted calibrates two things per language: a rejection bound,
and the scale of the score. Null texts and texts without a letter get ``und`` and score 0. If there is nothing to learn
from, every text gets ``und``. Ties go to the language first in code point order. Only id, text and language are read.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle, text_slices
from schedlake.llm.quality import held_out

ORDER = 4
#: Documents per language that are learned from; one in ten calibrates.
PER_LANGUAGE = 1000
#: Scored n-grams that a task keeps.
KEPT = 1 << 19
NONE = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: is it a letter (category L)?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each led by ORDER-1 blanks, with runs of non-letters as one blank; where each begins."""
    lead = " " * (ORDER - 1)
    # a line feed marks where a text begins and survives the clean-up
    points = np.frombuffer("".join("\n" + t.lower().replace("\n", " ") for t in texts).encode("utf-32-le", "replace"), np.uint32).copy()
    begin = points == 10
    blank = ~letter_table()[points] & ~begin
    points[blank] = 32
    keep = ~(blank & np.concatenate([[False], (blank | begin)[:-1]]))
    points, begin = points[keep], begin[keep]
    sizes = np.where(begin, len(lead), 1)
    out = np.repeat(np.where(begin, 32, points), sizes)
    return out, (np.cumsum(sizes) - sizes)[begin]


def hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of the last ``order`` columns of a table of characters."""
    h = np.full(len(chars), order + 1, np.uint64)
    for j in range(chars.shape[1] - order, chars.shape[1]):
        h = (h ^ chars[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as rows, one per character after the lead; first row of each text)."""
    ends = np.append(starts[1:], len(points))
    last = np.ones(len(points), bool)
    for j in range(ORDER - 1):
        last[starts + j] = False
    rows = np.flatnonzero(last)
    grams = np.stack([points[rows - (ORDER - 1 - j)] for j in range(ORDER)], axis=1)
    counts = ends - starts - (ORDER - 1)
    return grams, np.concatenate([[0], np.cumsum(counts)])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        by_language: dict[str, list[str]] = defaultdict(list)
        for text, language in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
            by_language[language].append(text or "")
        for language, texts in sorted(by_language.items()):
            grams, _ = windows(*letters(texts))
            if len(grams):
                kinds, n = np.unique(grams, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(n)), pa.array(["".join(map(chr, g)) for g in kinds.tolist()]), pa.array(n)], ["lang", "gram", "n"])


class KneserNey:
    """One language's model."""

    def __init__(self, counts: dict[str, int]):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.alphabet = len({g[-1] for g in counts}) + 1
        for order in range(ORDER, 0, -1):
            values = np.fromiter(counts.values(), np.float64, len(counts))
            once, twice = (values == 1).sum(), (values == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total: dict[str, float] = defaultdict(float)
            kinds: dict[str, int] = defaultdict(int)
            for gram, n in counts.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            chars = np.array([list(map(ord, g)) for g in counts], np.uint32).reshape(len(counts), order)
            shares = (values - discount) / np.fromiter((total[g[:-1]] for g in counts), np.float64, len(counts))
            contexts = np.array([list(map(ord, c)) for c in total], np.uint32).reshape(len(total), order - 1)
            weights = np.fromiter((discount * kinds[c] / total[c] for c in total), np.float64, len(total))
            gh, ch = hashes(chars, order), hashes(contexts, order - 1)
            go, co = np.argsort(gh), np.argsort(ch)
            self.levels.insert(0, (gh[go], shares[go], ch[co], weights[co]))
            lower: dict[str, int] = defaultdict(int)
            for gram in counts:
                lower[gram[1:]] += 1
            counts = lower

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(last character | the characters before it), by row."""

        def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], missing)

        p = np.full(len(grams), 1 / self.alphabet)
        for order, (gh, shares, ch, weights) in enumerate(self.levels, 1):
            p = look(gh, shares, hashes(grams, order), 0.0) + look(ch, weights, hashes(grams[:, :-1], order - 1), 1.0) * p
        return np.log(p)


class Scorer:
    """Cross-entropies of texts under all models; n-grams scored before are looked up in one sorted array."""

    def __init__(self, models: list[KneserNey]):
        self.models = models
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(models)))

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and model, has a letter)."""
        grams, first = windows(*letters(texts))
        counts = np.diff(first)
        lettered = np.zeros(len(texts), bool)
        out = np.zeros((len(texts), len(self.models)))
        if not len(grams):
            return out, lettered
        kinds, at, where = np.unique(hashes(grams, ORDER), return_index=True, return_inverse=True)
        fresh = np.ones(len(kinds), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)] != kinds
        if len(self.keys) + fresh.sum() > KEPT:
            self.keys, self.scores, fresh = self.keys[:0], self.scores[:0], np.ones(len(kinds), bool)
        if fresh.any():
            found = np.stack([m.log_probability(grams[at[fresh]]) for m in self.models], axis=1)
            keys = np.concatenate([self.keys, kinds[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.scores = keys[order], np.concatenate([self.scores, found])[order]
        own = self.scores[np.searchsorted(self.keys, kinds)]
        full = np.flatnonzero(counts)
        is_letter = (grams[:, -1] != 32).astype(np.int64)
        lettered[full] = np.add.reduceat(is_letter, first[:-1][full]) > 0
        for j in range(out.shape[1]):
            out[full, j] = -np.add.reduceat(own[where, j], first[:-1][full]) / counts[full]
        return out, lettered


def _entropies(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for part in text_slices(batches):
            ce, lettered = scorer.cross_entropies([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ce.tolist(), pa.list_(pa.float64())), pa.array(lettered)], ["doc_id", "ce", "lettered"])

    return run


def identify(docs: DataFrame, teach: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, cross_entropy, rejected.

    ``teach`` (doc_id, text, lang) holds the documents that may be learned from; per language the ``per_language`` ones
    with the smallest hash are. The models are broadcast: their size is bounded by that sample.
    """
    spark = docs.sparkSession
    known = teach.filter(F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit(9)).alias("mark"))
    # twice the share that is needed passes by its hash before anything is shuffled, so a frequent language is no large
    # group; rarer languages pass whole. One number per language reaches the driver, as does one model later.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 2.0 * per_language / n)]), F.col("lang")) if sizes else F.lit(0.0)
    passed = known.filter(F.pmod("mark", F.lit(1 << 30)) < share * float(1 << 30))
    ranked = passed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 30)), "mark", "doc_id"))).filter(F.col("place") <= per_language)
    chosen = settle(ranked.select("doc_id", "lang", (F.col("place") % 10 == 0).alias("calibrates")))
    # per_language rows for each language are broadcast
    texts = settle(teach.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    counts = texts.filter("not calibrates").select("lang", "text").mapInArrow(_gram_counts, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_language: dict[str, dict[str, int]] = defaultdict(dict)
    for row in counts.toPandas().sort_values(["lang", "gram"]).itertuples():  # n-gram kinds of the bounded sample
        by_language[row.lang][row.gram] = int(row.n)
    languages = sorted(by_language)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not languages:
        return docs.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    held = spark.sparkContext.broadcast([KneserNey(by_language[x]) for x in languages])
    schema = f"doc_id {kind}, ce array<double>, lettered boolean"
    trial = texts.filter("calibrates").select("doc_id", "text").mapInArrow(_entropies(held), schema).join(F.broadcast(chosen), "doc_id").filter("lettered").select("lang", "ce").toPandas()
    bounds, spreads = [], []
    for j, language in enumerate(languages):
        own = np.array([ce[j] for ce, x in zip(trial["ce"], trial["lang"]) if x == language])
        bounds.append(float(np.quantile(own, 0.99) + 4 * own.std() + 0.1) if len(own) > 1 else float(np.log(held.value[j].alphabet)))
        spreads.append(float(own.std()) if len(own) > 1 else 0.1)
    scale = 1 / max(0.02, float(np.median(spreads)))
    found = docs.select("doc_id", "text").mapInArrow(_entropies(held), schema)
    best = F.array_min("ce")
    place = F.array_position("ce", best).cast("int")
    share = F.lit(1.0) / F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp((best - x) * scale))
    return found.select(
        "doc_id",
        F.when(F.col("lettered"), F.element_at(F.array(*map(F.lit, languages)), place)).otherwise(NONE).alias("lang_pred"),
        F.when(F.col("lettered"), share).otherwise(0.0).alias("score"),
        F.when(F.col("lettered"), best).alias("cross_entropy"),
        (~F.col("lettered") | (best > F.element_at(F.array(*map(F.lit, bounds)), place))).alias("rejected"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text gets its most likely language; ``rejected`` marks those beyond the calibrated bound."""
    docs = documents(spark, sf_dir)
    return identify(docs, docs.filter(~held_out())).withColumn("held_out", held_out())
