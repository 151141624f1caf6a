"""Near copies by the similarity of 5-word shingles, for the near-duplicate stage of the pipeline.

Two texts link when the Jaccard similarity of their sets of shingles (A-Z folded, words as in operator 8) is at least
``SIMILAR``, compared on the shingles themselves. Of each group of linked texts one row stays.

Texts meet in the groups that the caller gives (those of operator 8 in the pipeline) and in the buckets of a MinHash sketch
of ``BANDS`` bands of ``ROWS`` values: a pair at similarity 0.8 has no bucket in common in 5 of a million cases, more similar
pairs less often. In every bucket, rows are first compared with the next one in an order that differs from bucket to bucket,
then one row of each group of linked rows with one of the next group, again in changing order, as long as that settles many
buckets. What is left, groups of a bucket that are not alike where they were compared, is compared in full: blocks of texts
meet in cells, and a task compares the rows of a cell that share a bucket and are in different groups. No pair that meets is
lost, and pairs are written only where they link. Texts move only to cells in which they have candidates.

A text shorter than a shingle is its own only shingle; null and empty texts, and texts of blanks, link with each other. Rows
are told apart by their key, so rows that repeat id and text are rows of one group. A long text is one row of its cell; blocks
are bounded in shingles as well as in rows, so a cell holds few of them. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.llm.common import components, settle, text_bytes, text_slices, whole_groups

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 6
#: Texts and shingles of a block that meets another block in one cell, shingles hashed at once, bytes of text compared at once.
BLOCK, BLOCK_SHINGLES, STEP, CELL_BYTES = 512, 200_000, 2048, 8 << 20
#: Rows of a bucket that are ordered together; share of open groups from which on a turn counts as having settled little.
PART, SETTLED = 1000, 0.75

_FACTORS = np.random.default_rng(8).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def buckets(kinds: set[bytes]) -> np.ndarray:
    """One 64-bit bucket per band from the smallest values of BANDS * ROWS permutations."""
    import xxhash

    hashes = np.frombuffer(b"".join(map(xxhash.xxh32_digest, kinds)), ">u4").astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + STEP]).min(axis=1), out=least)
    raw = least.tobytes()
    size = 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64)


def sketches(keyed: DataFrame) -> DataFrame:
    """(key, n, bands): number of different shingles and buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            kinds = [shingles(b) for b in text_bytes(part)]
            bands = np.stack([buckets(k) for k in kinds])
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array([len(k) for k in kinds], pa.int32()), pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), bands.ravel())],
                ["key", "n", "bands"])

    return keyed.select("key", "text").mapInArrow(run, "key bigint, n int, bands array<bigint>")


def _alike(n: Column, m: Column) -> Column:
    """Sets of such sizes can reach SIMILAR."""
    return F.least(n, m) >= F.greatest(n, m) * SIMILAR


class _Groups:
    """Groups of keys that grow by links."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = self.top
        while (up := top.setdefault(x, x)) != x:
            top[x] = top.setdefault(up, up)
            x = up
        return x


def _near(x: set[bytes], y: set[bytes]) -> bool:
    common = len(x & y)
    return common >= SIMILAR * (len(x) + len(y) - common) - 1e-9


def _cells(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that ``links`` finds in each whole cell, given the cell's table and the texts' shingles."""
    for table in whole_groups(batches, "cell", CELL_BYTES, lambda b: b.nbytes):
        cells = table.column("cell").to_numpy()
        cuts = [*np.flatnonzero(np.diff(cells, prepend=cells[0] - 1)).tolist(), len(cells)]
        found: list[tuple[int, int]] = []
        for low, high in zip(cuts, cuts[1:]):
            part = table.slice(low, high - low)
            texts = part.column("text").combine_chunks().cast(pa.binary()).to_pylist()
            found += links(part, [shingles(t or b"") for t in texts])
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _listed(part: pa.Table, kinds: list[set[bytes]]) -> list[tuple[int, int]]:
    """Links among the pairs that the rows of a cell list, but for those that earlier links imply."""
    keys, groups, found = part.column("key").to_pylist(), _Groups(), []
    place = {k: i for i, k in enumerate(keys)}
    for key, mine, others in zip(keys, kinds, part.column("others").to_pylist()):
        for other in others or ():
            x, y = groups.root(key), groups.root(other)
            if x != y and _near(mine, kinds[place[other]]):
                groups.top[x] = y
                found.append((key, other))
    return found


def _across(part: pa.Table, kinds: list[set[bytes]]) -> list[tuple[int, int]]:
    """Links between rows of a cell that meet in a bucket and are in different groups so far.

    A cell of two spots compares rows of different spots only; those of one spot meet in that spot's own cell.
    """
    keys, groups, found = part.column("key").to_pylist(), _Groups(), []
    component, spot, n = (part.column(c).to_numpy() for c in ("component", "spot", "n"))
    bands = np.array(part.column("bands").to_pylist(), np.int64)
    two = spot.min() != spot.max()
    for i in range(len(keys) - 1):
        rest = slice(i + 1, None)
        sizes = (np.minimum(n[rest], n[i]) >= np.maximum(n[rest], n[i]) * SIMILAR) & (component[rest] != component[i])
        if two:
            sizes &= spot[rest] != spot[i]
        at = i + 1 + np.flatnonzero(sizes)
        for j in at[(bands[at] == bands[i]).any(axis=1)].tolist():
            x, y = groups.root(int(component[i])), groups.root(int(component[j]))
            if x != y and _near(kinds[i], kinds[j]):
                groups.top[x] = y
                found.append((keys[i], keys[j]))
    return found


def _compared(rows: DataFrame, links) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _cells(batches, links), "a bigint, b bigint")


def verified(pairs: DataFrame, homes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Links (a, b) that join the same texts as all those of ``pairs`` (a, b) whose similarity reaches SIMILAR."""
    placed = pairs.join(homes.select(F.col("key").alias("a"), F.col("spot").alias("p")), "a").join(homes.select(F.col("key").alias("b"), F.col("spot").alias("q")), "b")
    placed = settle(placed.select("a", "b", F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("cell")))
    ends = placed.select("cell", F.col("a").alias("key"), F.col("b").alias("other")).unionByName(placed.select("cell", F.col("b").alias("key"), F.lit(None).cast("bigint").alias("other")))
    needed = ends.groupBy("cell", "key").agg(F.collect_list("other").alias("others"))
    return _compared(needed.join(keyed, "key").select("cell", "key", "others", "text"), _listed)


def spots(met: DataFrame) -> DataFrame:
    """(key, spot): a block of texts that share buckets, bounded in rows and shingles. ``met``: band, key, n, low."""
    home = met.groupBy("key").agg(F.min("low").alias("home"), F.first("n").alias("n"))
    nearer = met.select("band", "key").join(home, "key").groupBy("band").agg(F.min("home").alias("home"))
    home = home.select("key", "n").join(met.select("band", "key").join(nearer, "band").groupBy("key").agg(F.min("home").alias("home")), "key")
    blocks = home.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    return home.join(blocks, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), "blocks")).alias("spot"))


def beside(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of neighbours in each bucket, in an order that differs by bucket and turn. ``members``: band, key, n, c.

    A crowded bucket is ordered in parts, so that no task sorts a whole one.
    """
    mark = F.xxhash64("key", "band", F.lit(turn))
    part = F.pmod(F.shiftright(mark, 20), F.ceil(F.col("c") / PART).cast("long"))
    order = Window.partitionBy("band", "part").orderBy("mark", "key")
    dealt = members.withColumn("mark", mark).withColumn("part", part)
    met = dealt.select("key", "n", F.lag("key").over(order).alias("other"), F.lag("n").over(order).alias("m")).filter("other IS NOT NULL")
    return met.filter(_alike(F.col("n"), F.col("m"))).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def near_copies(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(key, component) of every text of ``docs`` (key, text) that links with another; ``key`` numbers the rows.

    ``groups`` (key, grp): rows of one group meet as if they shared a bucket.
    """
    keyed = docs.select("key", "text")
    sketch = sketches(keyed)
    if groups is not None:
        sketch = sketch.join(groups, "key").select("key", "n", F.concat("bands", F.array(F.xxhash64(F.lit("group"), "grp"))).alias("bands"))
    sketch = settle(sketch)
    each = sketch.select("key", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("low")).filter("c > 1")
    met = settle(each.join(shared, "band"))
    homes = settle(spots(met))
    links = settle(verified(settle(beside(met, 0)), homes, keyed))

    open_members = None
    for turn in range(1, 1000):
        reach = components(links)
        named = met.filter("c > 2").select("band", "key", "n").join(reach.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        first = F.min(F.struct(F.xxhash64("key", "band", F.lit(turn)).alias("mark"), "key", "n")).alias("first")
        each_group = settle(named.groupBy("band", "component").agg(first))
        several = each_group.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        members = settle(each_group.join(several, "band").select("band", "c", "first.key", "first.n"))
        left = members.count()
        if not left:
            return reach
        if open_members is not None and left > SETTLED * open_members:
            break
        open_members = left
        links = settle(links.unionByName(verified(settle(beside(members, turn)), homes, keyed)))

    # what neighbours do not decide: all pairs of a bucket across groups, block by block inside tasks
    rest = settle(named.join(several, "band", "left_semi").join(homes, "key"))
    here = rest.select("band", "spot").distinct()
    meet = here.join(here.select("band", F.col("spot").alias("other")), "band").filter("spot <= other").select("spot", "other").distinct()
    cells = meet.select(F.xxhash64("spot", "other").alias("cell"), F.explode(F.array_distinct(F.array("spot", "other"))).alias("spot"))
    rows = rest.select("key", "component", "spot").distinct().join(cells, "spot").join(sketch, "key").join(keyed, "key")
    found = _compared(rows.select("cell", "key", "component", "spot", "n", "bands", "text"), _across)
    return components(links.unionByName(found))
