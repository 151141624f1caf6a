"""Operator 6: embedding near-dedup by NN-descent.

Equal vectors become one row first. Neighbour lists start from vectors that lie next to each other when sorted by the signs
and the length of random projections, several times over; they are then refined round by round: the neighbours of a vector,
in both directions, meet at it and offer themselves to each other's lists. Every link found on the way is kept, so lists
only decide what is looked at next. Rounds end when none finds a new link.

A list whose last entry is still a link is saturated: there may be more links than the list holds. Inside the group of vectors that
links reach, such lists are enlarged to the whole group, compared in blocks that count links and write no pairs, so the counts
in a group of any size are exact. Beyond it they go on with the nearest vectors of other groups, refined in the same way; where that finds a
link the groups are joined and the lists go on beyond both. Of the pairs that link where vectors meet, as many are kept as join the
same vectors. A bounded set of audit queries is compared with all vectors in blocks; while the share of their links found is
below ``RECALL``, new projections are added, ``MORE`` times at most; the share reached is returned as ``audit_recall``, and below
``LEAST`` the operator stops with an error.

Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths with each other. Rows that repeat id and vector count as copies; of an id that comes with several vectors
the first in byte order links, the others do not. A row with a null id belongs to the group of its vector but is no
link of it. Labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from schedlake.llm.common import components, settle, whole_groups

#: Entries of a neighbour list, tables of projections at the start, and neighbours taken from each side in a table.
LIST, TABLES, NEXT = 8, 8, 4
#: Vectors compared at once; audit queries; share of their links that must be found; times that tables are added.
BLOCK, AUDIT, RECALL, MORE = 512, 1024, 0.999, 3
#: Share below which the operator stops with an error instead of reporting it in ``audit_recall``.
LEAST = 0.99
#: Neighbours of one vector that meet in one step; a vector with more lets them meet in such blocks.
MEET = 256
#: Rows of one vector's meeting that one task holds; share of list entries below which a round counts as settled.
PART, SETTLED = 4096, 0.01
#: Marker before a vector's bytes: the precision of its column.
KINDS = {b"4": "f4", b"8": "f8"}


def _unit(batch: pa.RecordBatch | pa.Table, column: str = "vec") -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to the longest of the batch."""
    raw = batch.column(column).to_pylist()
    kind = np.dtype(KINDS[raw[0][:1]]) if raw else np.dtype("f4")
    width = max((len(b) - 1 for b in raw), default=0) // kind.itemsize
    out = np.zeros((len(raw), width))
    for i, b in enumerate(raw):
        out[i, : (len(b) - 1) // kind.itemsize] = np.frombuffer(b, kind, offset=1)
    largest = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(largest > 0, largest, 1)  # squares of very large or small components stay in range
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def _sizes(batch: pa.RecordBatch | pa.Table, column: str = "vec") -> np.ndarray:
    return np.array([len(b) for b in batch.column(column).to_pylist()], np.int64)


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): vectors as bytes in the column's own precision, null where a vector cannot link."""
    kind = b"4" if isinstance(table.schema[vec_col].dataType.elementType, FloatType) else b"8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = np.array([math.nan if c is None else c for c in v], KINDS[kind]) if v else np.zeros(0)
                out.append(kind + x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    named = table.schema[id_col].dataType.simpleString()
    return table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, f"id {named}, vec binary")


def _projected(tables: range, bits: int, group: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch)
            for t in tables:
                rng = np.random.default_rng([t, unit.shape[1]])
                at = unit @ rng.standard_normal((unit.shape[1], bits + 1))
                signs = (at[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                kept = ["id", "vec", "grp"] if group else ["id", "vec"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(signs), pa.array(at[:, bits]), *map(batch.column, kept)], ["t", "signs", "along", *kept])

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of vectors at most NEXT places apart in the sorted rows of a partition."""
    tail: pa.RecordBatch | None = None
    for batch in batches:
        rows = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        unit, ids, sizes = _unit(rows), rows.column("id").to_numpy(), _sizes(rows)
        for gap in range(1, min(NEXT, len(ids) - 1) + 1):
            same = sizes[gap:] == sizes[:-gap]
            cos = np.einsum("ij,ij->i", unit[gap:], unit[:-gap])
            a, b = ids[gap:][same], ids[:-gap][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.tile(cos[same], 2))], ["a", "b", "cos"])
        tail = rows.slice(max(0, rows.num_rows - NEXT))


def start(reps: DataFrame, tables: range, bits: int) -> DataFrame:
    """(a, b, cos) from sorted random projections; dense stretches are cut by range, not by key."""
    spread = reps.mapInArrow(_projected(tables, bits), "t int, signs bigint, along double, id bigint, vec binary")
    return spread.repartitionByRange("t", "signs", "along").sortWithinPartitions("t", "signs", "along").mapInArrow(_beside, "a bigint, b bigint, cos double")


def top_lists(pairs: DataFrame) -> DataFrame:
    """The LIST nearest of each vector: (a, b, cos). A vector's own rows are ranked in map tasks before the shuffle."""
    once = pairs.filter("a <> b").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b")))
    return ranked.filter(F.col("r") <= LIST).drop("r")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same rows as all those in the matrix ``near``, one fewer than each group has rows."""
    links, seen = [], ~near.any(axis=1)
    for root in range(len(near)):
        if seen[root]:
            continue
        seen[root], open_rows = True, [root]
        while open_rows:
            at = open_rows.pop()
            found = np.flatnonzero(near[at] & ~seen).tolist()
            seen[found] = True
            links += [(at, x) for x in found]
            open_rows += found
    return links


def _meet(threshold: float):
    """Pairs of one meeting that a list can take (``offer``) and links that join all that link there, with the groups not equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "at", 8192, lambda b: b.num_rows):
            at, ids, last, grp = (table.column(c).to_numpy() for c in ("at", "id", "last", "grp"))
            unit, sizes = _unit(table), _sizes(table)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            a, b, c, joined = [], [], [], []
            for low, high in zip(cuts, np.append(cuts[1:], len(at))):
                for lo in range(low, high, MEET):
                    hi = min(lo + MEET, high)
                    cos = unit[lo:hi] @ unit[lo:hi].T
                    may = (sizes[lo:hi, None] == sizes[None, lo:hi]) & (grp[lo:hi, None] != grp[None, lo:hi]) & (ids[lo:hi, None] != ids[None, lo:hi])
                    x, y = np.nonzero((cos > last[lo:hi, None]) & may)
                    a.append(ids[lo:hi][x])
                    b.append(ids[lo:hi][y])
                    c.append(cos[x, y])
                    joined += [(lo + x, lo + y, cos[x, y]) for x, y in _forest((cos >= threshold) & may)]
            x, y, cos = np.concatenate(a), np.concatenate(b), np.concatenate(c)
            order = np.lexsort((-cos, x))  # of what meets in this batch, a list can take LIST entries only
            x, y, cos = x[order], y[order], cos[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < 2 * LIST
            p, q, w = (np.array(v) for v in zip(*joined)) if joined else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[keep], ids[p]])), pa.array(np.concatenate([y[keep], ids[q]])), pa.array(np.concatenate([cos[keep], w])),
                 pa.array(np.arange(keep.sum() + len(w)) < keep.sum())],
                ["a", "b", "cos", "offer"])

    return run


def refine(reps: DataFrame, lists: DataFrame, near: DataFrame, threshold: float, turn: int) -> DataFrame:
    """(a, b, cos, offer) from vectors that have a neighbour in common in ``lists`` or ``near`` (a, b).

    Offers are better than the last entry of a's list in ``lists``. ``reps`` has a group per vector (``grp``): only vectors of different
    groups are offered to each other. A vector where very many meet lets them meet in parts, dealt anew in every turn.
    """
    worst = lists.groupBy(F.col("a").alias("id")).agg(F.when(F.count(F.lit(1)) >= LIST, F.min("cos")).otherwise(-2.0).alias("last"))
    known = reps.select("id", "vec", "grp").join(worst, "id", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    both = lists.select("a", "b").unionByName(near.select("a", "b"))
    edges = both.select(F.col("a").alias("at"), F.col("b").alias("id")).unionByName(both.select(F.col("b").alias("at"), F.col("a").alias("id"))).distinct()
    parts = edges.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    dealt = edges.join(parts, "at").select("at", "id", F.pmod(F.xxhash64("id", F.lit(turn)), "parts").alias("part"))
    own = parts.select("at", F.col("at").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    named = dealt.unionByName(own).select(F.xxhash64("at", "part").alias("at"), "id")
    met = named.join(known, "id").repartition("at").sortWithinPartitions("at", F.xxhash64("id", F.lit(turn)))
    return met.select("at", "id", "last", "grp", "vec").mapInArrow(_meet(threshold), "a bigint, b bigint, cos double, offer boolean")


def descend(reps: DataFrame, lists: DataFrame, near: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Refine ``lists`` until hardly an entry changes. Returns (lists, links found)."""
    links = None
    for turn in range(1, 1000):
        met = settle(refine(reps, lists, near, threshold, turn))
        linked = met.filter(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = settle((linked if links is None else links.unionByName(linked)).distinct())
        better = settle(top_lists(lists.unionByName(met.filter("offer").select("a", "b", "cos"))))
        old = lists.select("a", "b", F.lit(1).alias("old"))
        entries, kept = better.join(old, ["a", "b"], "left").agg(F.count(F.lit(1)), F.count("old")).first()
        lists = better
        if entries - kept <= SETTLED * entries:
            break
    return lists, links


def _other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the sorted rows of a partition, each vector with the last one before it that belongs to another group."""
    before: tuple | None = None  # the last row of the run before, and of the current run
    current: tuple | None = None
    for rows in batches:
        unit, ids, grp, sizes, raw = _unit(rows), rows.column("id").to_numpy(), rows.column("grp").to_numpy(), _sizes(rows), rows.column("vec")
        a, b, cos = [], [], []
        for i in range(len(ids)):
            if current is not None and current[1] != grp[i]:
                before = current
            current = (ids[i], grp[i], sizes[i], unit[i])
            if before is not None and before[2] == sizes[i]:
                c = float(unit[i] @ before[3][: unit.shape[1]]) if unit.shape[1] <= len(before[3]) else float(unit[i][: len(before[3])] @ before[3])
                a += [ids[i], before[0]]
                b += [before[0], ids[i]]
                cos += [c, c]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cos, pa.float64())], ["a", "b", "cos"])


def enlarged(reps: DataFrame, lists: DataFrame, links: DataFrame, threshold: float, tables: range, bits: int) -> DataFrame:
    """Links between groups whose vectors have saturated lists: the lists go on with the nearest vectors of other groups.

    Saturated vectors are sorted by projections again and start from their neighbours of other groups; these lists are refined
    through the first lists and themselves. While that joins groups, the lists go on outside the joined ones, so in the end the
    last entry of each is no link.
    """
    full = lists.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.min("cos").alias("last")).filter((F.col("c") >= LIST) & (F.col("last") >= threshold)).select("id")
    held = settle(reps.join(full, "id", "left_semi"))
    inner = settle(lists.select("a", "b").join(held.select(F.col("id").alias("a")), "a", "left_semi").join(held.select(F.col("id").alias("b")), "b", "left_semi"))
    for _ in range(1000):
        reach = settle(components(links))
        grouped = settle(held.drop("grp").join(reach.withColumnRenamed("component", "grp"), "id"))
        before = grouped.agg(F.count_distinct("grp")).first()[0]
        if before < 2:
            break
        spread = grouped.mapInArrow(_projected(tables, bits, group=True), "t int, signs bigint, along double, id bigint, vec binary, grp bigint")
        ordered = [spread.repartitionByRange("t", "signs", "along").sortWithinPartitions("t", "signs", F.col("along") * way) for way in (1, -1)]
        start_pairs = settle(ordered[0].mapInArrow(_other, "a bigint, b bigint, cos double").unionByName(ordered[1].mapInArrow(_other, "a bigint, b bigint, cos double")))
        _, found = descend(grouped, settle(top_lists(start_pairs)), inner, threshold)
        direct = start_pairs.filter((F.col("cos") >= threshold) & (F.col("a") < F.col("b"))).select("a", "b")
        new = settle(found.unionByName(direct).distinct())
        if new.isEmpty():
            break
        links = settle(links.unionByName(new).distinct())
    return links


def _count_cell(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        unit, sizes = _unit(rows), _sizes(rows)
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy().astype(float)
        block = rows.column("block").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (unit[left] @ unit[right].T >= threshold) & (sizes[left, None] == sizes[None, right])
        if i == j:
            near &= ids[left, None] != ids[None, right]
            return pa.table({"id": ids[left], "linked": near @ n[right]})
        return pa.table({"id": np.concatenate([ids[left], ids[right]]), "linked": np.concatenate([near @ n[right], n[left] @ near])})

    return run


def count_links(reps: DataFrame, reach: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): for vectors of one group, rows linked to each, counted in cells of two blocks; no pair is written."""
    size = reach.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = reps.join(reach, "id").join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = member.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "vec")
    counted = cells.groupBy("component", "i", "j").applyInArrow(_count_cell(threshold), "id bigint, linked double")
    return counted.groupBy("id").agg(F.sum("linked").cast("long").alias("linked"))


def _audit(queries, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = queries.value
        total = np.zeros(len(raw))
        asked = pa.table({"vec": pa.array([v for _, v in raw], pa.binary())})
        unit, sizes, ids = _unit(asked), _sizes(asked), np.array([i for i, _ in raw])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                other = _unit(part)
                width = min(other.shape[1], unit.shape[1])
                near = (unit[:, :width] @ other[:, :width].T >= threshold) & (sizes[:, None] == _sizes(part)[None]) & (ids[:, None] != part.column("id").to_numpy()[None])
                total += near @ part.column("n").to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "exact"])

    return run


def audit(reps: DataFrame, counts: DataFrame, reach: DataFrame, threshold: float) -> float:
    """Share of links found, against all vectors in blocks: the mean over AUDIT queries (a hash picks them) that have links,
    queries of one group counting as one, so that a large group hides nothing."""
    chosen = reps.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(AUDIT).select("id", "vec").collect()  # AUDIT vectors
    if not chosen:
        return 1.0
    held = reps.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["vec"])) for r in chosen])
    exact = reps.select("id", "vec", "n").mapInArrow(_audit(held, threshold), "id bigint, exact double").groupBy("id").agg(F.sum("exact").alias("exact")).filter("exact > 0")
    share = F.coalesce("linked", F.lit(0)) / F.col("exact")
    per_group = exact.join(counts, "id", "left").join(reach, "id", "left").groupBy(F.coalesce("component", "id").alias("g")).agg(F.avg(share).alias("share"))
    return float(per_group.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0])


def near_vectors(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept, audit_recall."""
    every = settle(vectors(table, id_col, vec_col).select(F.col("id").cast("long").alias("id"), "vec"))
    classes = every.filter("vec IS NOT NULL AND id IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    reps = settle(classes.groupBy("id").agg(F.min(F.struct("vec", "n")).alias("v")).select("v.vec", "id", "v.n"))
    total = reps.count()
    bits = max(1, math.ceil(math.log2(max(2, total / LIST))))
    reps = reps.withColumn("grp", F.col("id"))  # at first every vector is a group
    lists, links, recall = None, None, 0.0
    for more in range(MORE + 1):
        tables = range(more * TABLES, (more + 1) * TABLES)
        beside = settle(start(reps, tables, bits))
        chained = beside.filter((F.col("cos") >= threshold) & (F.col("a") < F.col("b"))).select("a", "b")
        lists, found = descend(reps, settle(top_lists(beside if lists is None else beside.unionByName(lists))), beside.select("a", "b").limit(0), threshold)
        entered = lists.filter(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        parts = [chained, found, entered] + ([links] if links is not None else [])
        links = settle(reduce(DataFrame.unionByName, parts).distinct())
        links = enlarged(reps, lists, links, threshold, tables, bits)
        reach = settle(components(links))
        counts = settle(count_links(reps, reach, threshold))
        recall = audit(reps, counts, reach, threshold)
        if recall >= RECALL:
            break
    else:
        if recall < LEAST:
            raise RuntimeError(f"recall {recall:.4f} after {MORE + 1} sets of projections is below {LEAST}")
    group = reps.join(reach, "id", "left").join(counts, "id", "left").select(
        "vec", F.coalesce("component", "id").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("linked"))
    return every.join(group, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), k AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY 1
)
SELECT vec_id, (SELECT count(*) FROM k WHERE k.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS audit_recall
FROM v JOIN c ON c.a = vec_id
"""
