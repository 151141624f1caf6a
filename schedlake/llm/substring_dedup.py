"""Operator 2: substring dedup with prefix-partitioned suffix trees.

Suffixes start at every word; only their first ``WINDOW`` words matter. Each suffix is keyed by a variable-length prefix:
from its first word to the end of the ``GRAM``-word run with the smallest hash inside its window. Equal windows have equal
prefixes, and one run serves all suffixes that start in the words before it, so suffixes whose prefixes end in the same
run travel together in one snippet of text. Steps:

1. Per document, the runs with the suffixes they serve: a run, a fingerprint of the snippet, its place. No words move.
2. Runs found in one document only have no repeats and go. Equal snippets become one class with its smallest document; all
   later members of a class are repeats without looking at words.
3. Classes that share a run but differ send one snippet of words each to the run's group. A group holds at most ``GROUP``
   snippets; where more share a run, the prefix is lengthened to the whole window and its suffixes are grouped by that.
4. Inside a group the suffix tree is built level by level: nodes of depth 1, 2, 4, .. name the substrings of that length,
   up to the depth of the window. A node that deep with suffixes of several documents is a repeat; every
   suffix below it that isn't in the node's smallest document is marked.

Marked suffixes are windows to remove; the words they cover go. Windows are judged on the input.

Null and empty texts and texts shorter than a window lose nothing. Rows with a null id are neither judged nor removed from.
Rows that repeat an id belong to one document, so they do not mark each other; each loses the words that its own text shares
with a smaller id, told apart by a hash of the text. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle, text_bytes, text_slices, whole_groups

WINDOW, GRAM = 50, 8
#: Snippets that a group may hold before its prefix is lengthened.
GROUP = 2000
#: Words of whole groups that are built into trees at once.
TREE_WORDS = 300_000
#: Bits of a key that hold a position inside a slice of texts.
PLACE_BITS = 28
#: Odd multipliers of the hashes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of several texts: 64-bit hash of each, byte spans, and the first word of each text (with one end entry)."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.joined, np.uint8)
        space = _SPACE[data]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.begin, offsets)
        lengths = self.end - self.begin
        if len(lengths):
            inside = np.arange(len(data)) - np.repeat(self.begin, np.diff(np.append(self.begin, len(data)))) if self.begin[0] == 0 else None
            if inside is None:
                inside = np.arange(len(data))
                inside[self.begin[0]:] -= np.repeat(self.begin, np.diff(np.append(self.begin, len(data))))
            powers = _powers(BYTE_BASE, int(lengths.max()) + 1)
            inside[space] = 0
            values = (data.astype(np.uint64) + np.uint64(1)) * powers[inside]
            values[space] = 0
            self.hash = _mix(np.add.reduceat(values, self.begin) ^ lengths.astype(np.uint64) * np.uint64(WORD_BASE))
        else:
            self.hash = np.zeros(0, np.uint64)

    def substring_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words[start:end], the same wherever these words stand."""
        n = len(self.hash)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * _powers(WORD_BASE, n), dtype=np.uint64)])
        back = _powers(pow(WORD_BASE, -1, 1 << 64), n + 1)
        return _mix((sums[end] - sums[start]) * back[start] ^ (end - start).astype(np.uint64))


def runs(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, run hash, run's first word, first suffix, number of suffixes) for every run that serves some suffix."""
    n, span = len(words.hash), window - gram + 1
    text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if n < window:
        return (np.zeros(0, np.int64),) * 5
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(WORD_BASE) + words.hash[j : n - gram + 1 + j]
    grams = _mix(grams)
    low = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)  # by suffix: its run
    whole = np.flatnonzero(text_of[: len(at)] == text_of[window - 1 :])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 5
    texts, at = text_of[whole], at[whole]
    cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (texts[1:] != texts[:-1])]))
    return texts[cuts], grams[at[cuts]].view(np.int64), at[cuts], whole[cuts], np.diff(np.append(cuts, len(whole)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        words = Words(text_bytes(part))
        text, run, place, start, n = runs(words)
        if not len(text):
            continue
        snippet = words.substring_hashes(start, start + n + WINDOW - 1) ^ _mix((place - start).astype(np.uint64))
        # a snippet that a document repeats is one row; places that follow each other without a gap are one range
        order = np.lexsort((start, snippet, text))
        text, run, snippet, start, n = (x[order] for x in (text, run, snippet, start, n))
        first = start - words.first[text]
        row = np.concatenate([[True], (text[1:] != text[:-1]) | (snippet[1:] != snippet[:-1])])
        piece = np.flatnonzero(row | np.concatenate([[True], first[1:] != first[:-1] + n[:-1]]))
        ends = np.append(piece[1:], len(first)) - 1
        ranges = pa.StructArray.from_arrays([pa.array(first[piece].astype(np.int32)), pa.array((first[ends] + n[ends]).astype(np.int32))], ["first", "last"])
        rows = np.flatnonzero(row)
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(piece, rows), len(piece)).astype(np.int32)), ranges)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(text[rows])), part.column("mark").take(pa.array(text[rows])), pa.array(run[rows]), pa.array(snippet[rows].view(np.int64)), pa.array(n[rows].astype(np.int32)), lists],
            ["doc_id", "mark", "run", "snippet", "n", "ranges"])


def _snippets(wide: DataFrame) -> DataFrame:
    """Words of the asked snippets: from (doc_id, text, asked array<struct<run, snippet, first, n, crowded>>).

    A crowded run sends one row per suffix with the hash of its whole window, any other a single row with its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = Words(text_bytes(part))
            rows: list[tuple] = []
            spans, crowded = [], []
            for i, (doc, asked) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("asked").to_pylist())):
                base = int(words.first[i])
                for a in asked:
                    start, n = base + a["first"], a["n"]
                    if a["crowded"]:
                        crowded.append((a["run"], a["snippet"], doc, start, n))
                    else:
                        rows.append((a["run"], a["snippet"], doc, n))
                        spans.append(words.hash[start : start + n + WINDOW - 1].tobytes())
            for at in range(0, len(rows), 5000):
                some = list(zip(*rows[at : at + 5000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[0], pa.int64()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.int64()), pa.array(some[3], pa.int32()),
                     pa.array(spans[at : at + 5000], pa.binary()), pa.nulls(len(some[0]), pa.int64())],
                    ["run", "snippet", "doc_id", "n", "words", "window"])
            for at in range(0, len(crowded), 500):
                r, s, d, start, n = (np.array(x, np.int64) for x in zip(*crowded[at : at + 500]))
                offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(start, n) + offset
                hashes = words.substring_hashes(first, first + WINDOW).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(r, n)), pa.array(np.repeat(s, n)), pa.array(np.repeat(d, n)), pa.array(offset.astype(np.int32)),
                     pa.nulls(len(first), pa.binary()), pa.array(hashes)],
                    ["run", "snippet", "doc_id", "n", "words", "window"])

    return wide.select("doc_id", "text", "asked").mapInArrow(run, "run bigint, snippet bigint, doc_id bigint, n int, words binary, window bigint")


def tree_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """Node of the suffix tree at ``depth`` for the suffix that starts at each word: equal numbers for equal substrings.

    Nodes double in depth: a substring of 2d words is a pair of nodes of depth d. Positions that reach past the end of
    their snippet get some number too; callers look only at suffixes with ``depth`` words.
    """
    def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]

    node, reached = np.unique(words, return_inverse=True)[1], 1
    while reached < depth:
        step = min(reached, depth - reached)
        node = named(node, np.roll(node, -step))
        reached += step
    return node


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked suffixes of whole groups: (run, snippet, spans) with the suffixes of the snippet's smallest document that a
    smaller document holds too."""
    for table in whole_groups(batches, "run", TREE_WORDS, lambda b: sum(b.column("n").to_pylist()) + (WINDOW - 1) * b.num_rows):
        n = table.column("n").to_numpy().astype(np.int64)
        docs = table.column("doc_id").to_numpy()
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        node = tree_nodes(words, WINDOW)
        lengths = n + WINDOW - 1
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        leaf = node[np.repeat(np.cumsum(lengths) - lengths, n) + offset]
        lowest = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, leaf, docs[row])
        marked = np.flatnonzero(lowest[leaf] < docs[row])
        if not len(marked):
            continue
        row, offset = row[marked], offset[marked]
        cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.append(cuts[1:], len(row)) - 1
        yield pa.RecordBatch.from_arrays(
            [table.column("run").take(pa.array(row[cuts])).combine_chunks(), table.column("snippet").take(pa.array(row[cuts])).combine_chunks(),
             pa.array(offset[cuts].astype(np.int32)), pa.array((offset[last] + 1).astype(np.int32))],
            ["run", "snippet", "low", "high"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last): ranges of suffixes of each text whose window also starts in a smaller document. ``mark`` is
    the XXH64 of the text; it tells rows that repeat an id apart."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).filter(F.col("doc_id").isNotNull())
    found = settle(numbered.mapInArrow(_runs, "doc_id bigint, mark bigint, run bigint, snippet bigint, n int, ranges array<struct<first: int, last: int>>"))
    # counted tables are settled before they are joined, so that both sides of each join are plain exchanges and AQE can
    # split the partitions of a run that very many documents hold
    shared = settle(found.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("run"))
    held = settle(found.join(shared, "run", "left_semi"))
    classes = settle(held.groupBy("run", "snippet").agg(F.min(F.struct("doc_id", "mark", F.col("ranges")[0]["first"].alias("first"), "n")).alias("low")).select("run", "snippet", "low.*"))
    mixed = settle(classes.groupBy("run").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    asked = classes.join(mixed, "run").select("doc_id", "mark", F.struct("run", "snippet", "first", "n", (F.col("kinds") > GROUP).alias("crowded")).alias("a"))
    wide = numbered.join(asked.groupBy("doc_id", "mark").agg(F.collect_list("a").alias("asked")), ["doc_id", "mark"])
    sent = settle(_snippets(wide))
    grouped = sent.filter("words IS NOT NULL").select("run", "snippet", "doc_id", "n", "words").repartition("run").sortWithinPartitions("run")
    in_trees = grouped.mapInArrow(_trees, "run bigint, snippet bigint, low int, high int")
    long_prefix = sent.filter("window IS NOT NULL").select("run", "snippet", "doc_id", "n", "window")
    lowest = long_prefix.groupBy("run", "window").agg(F.min("doc_id").alias("lowest"))
    by_window = long_prefix.join(lowest, ["run", "window"]).filter("lowest < doc_id").select("run", "snippet", F.col("n").alias("low"), (F.col("n") + 1).alias("high"))
    in_class = settle(in_trees.unionByName(by_window))
    members = held.join(classes.select("run", "snippet", F.col("doc_id").alias("lowest")), ["run", "snippet"])
    later = members.filter("doc_id > lowest").select("doc_id", "mark", F.inline("ranges"))
    # the smallest document of a class: each place of the snippet in its texts, and the suffixes marked there
    places = F.explode(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"] - 1, F.col("n")))))
    own = classes.select("run", "snippet", "doc_id").join(in_class, ["run", "snippet"]).join(held, ["run", "snippet", "doc_id"]).select("doc_id", "mark", "low", "high", places.alias("at"))
    return later.unionByName(own.select("doc_id", "mark", (F.col("at") + F.col("low")).alias("first"), (F.col("at") + F.col("high")).alias("last")))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        total, removed, digests = [], [], []
        for text, spans in zip(text_bytes(part), part.column("spans").to_pylist()):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                gone[s["first"]] += 1
                gone[s["last"] + WINDOW - 1] -= 1
            drop = np.cumsum(gone)[: len(words)] > 0
            total.append(len(words))
            removed.append(int(drop.sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if removed[-1] else b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removed_words(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256."""
    spans = repeated_spans(docs).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = spans.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "spans")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).join(own, (F.col("doc_id") == F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select("doc_id", "text", "spans")
    return texts.mapInArrow(_kept, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)
), h AS (
  SELECT doc_id, i, word, CASE WHEN i + 49 <= n THEN sha256(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS win
  FROM w
), m AS (
  SELECT win, min(doc_id) AS low FROM h WHERE win IS NOT NULL GROUP BY 1
), g AS (
  SELECT h.doc_id, i, word, coalesce(bool_or(low < h.doc_id) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), FALSE) AS gone
  FROM h LEFT JOIN m ON h.win = m.win
), r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""
