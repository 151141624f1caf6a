"""Operator 8: SimHash near-dedup by anchor-point covering.

A 64-bit SimHash is taken from the word shingles of each whole text. Two fingerprints link at ``threshold`` or fewer
differing bits. Anchors are the pairs of codewords of the binary Golay code of length 23, laid over two disjoint blocks of
23 bits: a perfect code, so every block has exactly one codeword within its covering radius 3. A fingerprint is at home at
its nearest anchor and is replicated to every anchor within covering radius plus threshold, split over the blocks in every
way: if x and y differ by e1 and e2 bits in the blocks (e1 + e2 <= threshold), y lies within 3 + e1 and 3 + e2 of the home
of x. So each link meets at the home of both ends and none is lost. Per anchor the members are compared with those at home,
and only each member's smallest reachable fingerprint is passed on, never all pairs.

Equal fingerprints become one row before anything is replicated, so copies cost nothing. Null and empty texts get
fingerprint zero and link like any other. Fewer words than a shingle: the whole sequence is the only shingle. Only the id
and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import components, documents, settle, text_bytes, text_slices

#: Fixed values of the Golay code: length, generator x^11+x^10+x^6+x^5+x^4+x^2+1, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b110001110101, 3
BLOCK = (1 << LENGTH) - 1
#: Pairs of an anchor that are compared in one vectorised step.
PAIRS = 1 << 20


def simhash(text: bytes, width: int = 3) -> bytes:
    """8 bytes, most significant first: a bit is 1 where over half of the shingles' hashes have it."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return bytes(8)
    whole, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= width:
        hashes = digest(whole, 42)
    else:
        hashes = b"".join([digest(whole[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])])
    table = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = [np.bincount(table[:, i], minlength=256) @ _BITS for i in range(8)]
    return np.packbits(np.concatenate(counts) * 2 > len(table)).tobytes()


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): SimHash as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fps = np.frombuffer(b"".join(simhash(b, width) for b in text_bytes(part)), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@lru_cache(maxsize=2)
def covering(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For extra = 0 .. threshold: error patterns that lead from a block to its codewords, by syndrome.

    ``extra`` 0 holds the one codeword within the covering radius, ``extra`` e those at distance 3 + e. Entries are
    (patterns, counts) with patterns[syndrome, :counts[syndrome]].
    """
    unit = [_remainder(1 << i) for i in range(LENGTH)]
    out = []
    for extra in range(threshold + 1):
        lists: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(RADIUS + 1) if extra == 0 else (RADIUS + extra,):
            for bits in combinations(range(LENGTH), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= unit[b]
                lists[syndrome].append(sum(1 << b for b in bits))
        width = max(map(len, lists))
        patterns = np.array([x + [0] * (width - len(x)) for x in lists], np.int64).reshape(1 << 11, width)
        out.append((patterns, np.array([len(x) for x in lists])))
    return out


def syndromes(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), np.int64)
    for i in range(LENGTH):
        out ^= np.where(blocks >> i & 1, _remainder(1 << i), 0)
    return out


def replicas(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, at home) for every anchor within covering radius plus threshold."""
    first, second = fps & BLOCK, fps >> LENGTH & BLOCK
    s1, s2 = syndromes(first), syndromes(second)
    anchors, rows, home = [], [], []
    for e1 in range(threshold + 1):
        for e2 in range(threshold + 1 - e1):
            (p1, n1), (p2, n2) = covering(threshold)[e1], covering(threshold)[e2]
            for i in range(p1.shape[1]):
                for j in range(p2.shape[1]):
                    has = np.flatnonzero((n1[s1] > i) & (n2[s2] > j))
                    anchors.append((first[has] ^ p1[s1[has], i]) << LENGTH | (second[has] ^ p2[s2[has], j]))
                    rows.append(has)
                    home.append(np.full(len(has), e1 == 0 and e2 == 0))
    return np.concatenate(anchors), np.concatenate(rows), np.concatenate(home)


def _replicate(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fps = batch.column("fp").to_numpy(zero_copy_only=False)[at : at + 2000]
                anchors, rows, home = replicas(fps, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fps[rows]), pa.array(home)], ["anchor", "fp", "home"])

    return run


def _labels(anchors: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For whole anchors, sorted: the smallest fingerprint that each member reaches at its anchor, where it isn't its own."""
    cuts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(cuts, len(anchors)))
    group = np.repeat(np.arange(len(cuts)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1))
    if not len(homes):
        return fps[:0], fps[:0]
    meets = sizes[group[homes]]
    labels = fps.copy()
    pieces = np.searchsorted(np.cumsum(meets), np.arange(PAIRS, int(meets.sum()) + PAIRS, PAIRS), side="left")
    steps = [(a, b) for a, b in zip([0, *(pieces + 1)], [*(pieces + 1), len(homes)]) if a < b and a < len(homes)]
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def links(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = meets[a:b]
        left = np.repeat(homes[a:b], n)
        right = np.repeat(cuts[group[homes[a:b]]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= threshold
        return left[near], right[near]

    if len(steps) == 1:
        kept = [links(*steps[0])]
    while True:
        before = labels.copy()
        for at in range(len(steps)):
            left, right = kept[at] if kept else links(*steps[at])
            np.minimum.at(labels, left, labels[right])
            np.minimum.at(labels, right, labels[left])
        if np.array_equal(before, labels):
            break
    moved = labels != fps
    return fps[moved], labels[moved]


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(a: np.ndarray, f: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            x, y = _labels(a, f, h, threshold)
            pairs = np.unique(np.stack([x, y]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "fp", "home")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:  # all but the last anchor are whole
                yield out(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield out(*held)

    return run


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (a, b) that join each distinct fingerprint of ``fps`` (fp) to what it reaches at its anchors."""
    spread = fps.mapInArrow(_replicate(threshold), "anchor bigint, fp bigint, home boolean")
    per_anchor = spread.repartition("anchor").sortWithinPartitions("anchor")
    return per_anchor.mapInArrow(_compare(threshold), "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id."""
    light = settle(fingerprints(docs, width))
    classes = settle(light.groupBy("fp").agg(F.min("doc_id").alias("low")))
    reach = components(links(classes.select("fp"), threshold))
    member = classes.join(reach.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = settle(member.join(lowest, "component").select("fp", "component_id"))
    return light.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
