"""Operator 12: Merkle manifest of a dataset by a nested-struct rollup.

Rows become leaves (a digest of length-prefixed values), are ranked in their group, and the digits of the rank become
columns. The leaves of one bounded block (ARITY ** DEPTH consecutive ranks) are dealt to one task once; there the digit
columns are grouped away one after the other, the lowest first, and every group becomes a struct that nests its children and
holds their joint digest. Blocks become the leaves of the next tier until each group is one node; the groups' subroots,
ordered by group, form one more such tree. On the way back each block, one row, receives the path above it; a nested
transform walks down the structs and an explode emits one proof per leaf. Proofs are never joined leaf by leaf or level by
level: only blocks, one row per 256 nodes, meet the path above them.

A frequent group is ranked in ranges of bounded size and split into blocks, so nothing of its size lands in one task.

Null values have their own encoding, a null group comes first, null ids come before others inside a group. Rows that repeat
an id are ordered by their leaf; fully equal rows are leaves of their own with equal digests. A group of one leaf has that
leaf as its subroot. An empty table gives no rows. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle

#: Children per node, and levels that one block covers.
ARITY, DEPTH = 2, 8
#: Rows that one range of a ranking holds, on average.
RANGE_ROWS = 20_000
#: Heights that a tree may have: 2 ** 62 leaves.
MAX_HEIGHT = 62

STEP = "array<struct<before:string,after:string>>"


def encoded(column: Column) -> Column:
    """A value with its UTF-8 byte count in front, ``-`` for null; numbers in decimal."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def group_key(column: Column) -> Column:
    """A non-null key that sorts like ``column`` bytewise with null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def ranked(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``rank`` (0-based inside ``grp`` by ``order``) and ``height`` of the group's tree; also the rows of the largest
    group. ``nodes`` is settled.

    The rows are cut into ranges of the whole order, so a group of any size spreads; equal rows are told apart by a number.
    """
    full = [*order, "__tie"]
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    numbered = nodes.withColumn("__tie", F.monotonically_increasing_id())
    ranged = settle(numbered.repartitionByRange(parts, "grp", *full).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy("grp"))
    offsets = counts.select("grp", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), height(total).alias("height"))
    most = counts.groupBy("grp").agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy("grp", "__part").orderBy(*full))
    placed = ranged.withColumn("__inside", inside).join(offsets, ["grp", "__part"])
    return placed.withColumn("rank", (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__before", "__inside", "__part", "__tie"), most


def height(total: Column) -> Column:
    """Levels above the leaves until one node remains."""
    powers = F.array(*[F.lit(ARITY**level) for level in range(MAX_HEIGHT + 1)])
    return F.size(F.filter(powers, lambda p: p < total))


def block_trees(nodes: DataFrame, base: int) -> DataFrame:
    """Roll the nodes of every block up to one nested struct: (grp, height, block, hash, kids).

    ``nodes``: grp, height, rank, hash, item. ``base`` is the level of the nodes in the whole tree. Levels above the height
    of a group hold one child each and pass its digest on.
    """
    digits = [f"d{level}" for level in range(DEPTH)]
    held = nodes.select(
        "grp", "height", F.expr(f"rank div {ARITY**DEPTH}").alias("block"),
        *[F.expr(f"cast((rank div {ARITY**level}) % {ARITY} as tinyint)").alias(name) for level, name in enumerate(digits)],
        "hash", F.col("item").alias("kids"),
    ).repartition("grp", "block")
    for level, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("digit"), "hash", "kids")
        held = held.groupBy("grp", "height", "block", *digits[level + 1 :]).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        joint = F.sha2(F.concat_ws("", F.col("kids.hash")).cast("binary"), 256)
        held = held.withColumn("hash", F.when(F.col("height") > base + level, joint).otherwise(F.col("kids")[0]["hash"]))
    return held.select("grp", "height", "block", "hash", "kids")


def _walk(kids: Column, level: int, above: Column, base: int) -> Column:
    """Entries (item, hash, path) of all leaves below ``kids``; a path lists the siblings of each level from the leaf up."""
    hashes = F.transform(kids, lambda kid: kid["hash"])

    def child(kid: Column, at: Column) -> Column:
        step = F.struct(
            F.concat_ws("", F.slice(hashes, F.lit(1), at)).alias("before"),
            F.concat_ws("", F.slice(hashes, at + 2, F.lit(ARITY))).alias("after"),
        )
        path = F.concat(F.when(F.col("height") > base + level, F.array(step)).otherwise(F.array().cast(STEP)), above)
        return _walk(kid["kids"], level - 1, path, base) if level else F.struct(kid["kids"].alias("item"), kid["hash"].alias("hash"), path.alias("path"))

    below = F.transform(kids, child)
    return F.flatten(below) if level else below


def paths(nodes: DataFrame, most: int, top: Callable[[DataFrame], DataFrame], base: int = 0) -> DataFrame:
    """(grp, item, hash, path, subroot, root) of every node, rolled up tier by tier.

    ``nodes``: grp, height, rank, hash, item; ``most``: nodes of the largest group. ``top`` receives (grp, subroot), one row per group, and returns
    grp, root and ``above``, the path from the subroot on.
    """
    blocks = settle(block_trees(nodes, base))
    left = -(-most // ARITY**DEPTH)
    if left > 1:
        upper = blocks.select("grp", "height", F.col("block").alias("rank"), "hash", F.struct("block").alias("item"))
        over = paths(upper, left, top, base + DEPTH).select("grp", F.col("item.block").alias("block"), F.col("path").alias("above"), "subroot", "root")
        met = blocks.join(over, ["grp", "block"])
    else:
        met = blocks.withColumnRenamed("hash", "subroot").join(top(blocks.select("grp", F.col("hash").alias("subroot"))), "grp")
    entries = met.select("grp", "subroot", "root", F.explode(_walk(F.col("kids"), DEPTH - 1, F.col("above"), base)).alias("e"))
    return entries.select("grp", "e.item", "e.hash", "e.path", "subroot", "root")


def _over_groups(subroots: DataFrame) -> DataFrame:
    """Path and root above each group's subroot: one more tree whose leaves are the subroots in the order of the groups."""
    def alone(roots: DataFrame) -> DataFrame:
        return roots.select("grp", F.col("subroot").alias("root"), F.array().cast(STEP).alias("above"))

    leaves = settle(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("hash")))
    nodes, most = ranked(leaves, ["of"])
    return paths(nodes.withColumn("item", F.struct("of")), most, alone).select(F.col("item.of").alias("grp"), F.col("path").alias("above"), "root")


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(grp, item, leaf, path, subroot, root) of every leaf. ``leaves``: grp (see ``group_key``), hash, item (a struct that
    travels along) and the columns ``order``, by which leaves ascend inside their group."""
    return paths(*ranked(settle(leaves), [*order, "hash"]), _over_groups).withColumnRenamed("hash", "leaf")


def folded(start: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, from the leaf's level up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))).cast("binary"), 256)


#: Fixed value: the fields of a leaf in their order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    values = {name: F.col(name) for name in FIELDS}
    changed = {**values, "n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        group_key(F.col("lang")).alias("grp"), leaf_digest(list(values.values())).alias("hash"), "doc_id",
        F.struct("doc_id", F.when(hit, leaf_digest(list(changed.values()))).alias("tampered")).alias("item"),
    )
    proofs = manifest(leaves, ["doc_id"])
    back = folded(F.coalesce("item.tampered", "leaf"), F.col("path"))
    found = proofs.select(F.col("item.doc_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE b AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS grp,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS told,
         coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS false_told,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
           lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, grp, sha256(head || told || tail) AS leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN sha256(head || false_told || tail) END AS tampered FROM b
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS rank, count(*) OVER (PARTITION BY grp) AS total FROM leaves
), low AS (
  SELECT grp, 0 AS level, rank AS pos, total AS n, leaf AS hash FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(max(hash) FILTER (pos % 2 = 0) || coalesce(max(hash) FILTER (pos % 2 = 1), '')) FROM low WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subroots AS (
  SELECT grp, hash AS subroot, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS total FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, rank AS pos, total AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(max(hash) FILTER (pos % 2 = 0) || coalesce(max(hash) FILTER (pos % 2 = 1), '')) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT p.doc_id, p.leaf, l.level, l.n, CASE WHEN (p.rank >> l.level) % 2 = 1 THEN coalesce(s.hash, '') ELSE '' END AS before,
         CASE WHEN (p.rank >> l.level) % 2 = 0 THEN coalesce(s.hash, '') ELSE '' END AS after
  FROM placed p JOIN (SELECT DISTINCT grp, level, n FROM low WHERE n > 1) l ON l.grp = p.grp
  LEFT JOIN low s ON s.grp = p.grp AND s.level = l.level AND s.pos = xor(p.rank >> l.level, 1::BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, 1000 + l.level, l.n, CASE WHEN (r.rank >> l.level) % 2 = 1 THEN coalesce(s.hash, '') ELSE '' END,
         CASE WHEN (r.rank >> l.level) % 2 = 0 THEN coalesce(s.hash, '') ELSE '' END
  FROM placed p JOIN subroots r ON r.grp = p.grp JOIN (SELECT DISTINCT level, n FROM high WHERE n > 1) l ON true
  LEFT JOIN high s ON s.level = l.level AND s.pos = xor(r.rank >> l.level, 1::BIGINT)
), proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256, list([before, after] ORDER BY level) AS path FROM steps GROUP BY doc_id, leaf
), folds AS (
  SELECT p.doc_id, p.leaf, p.grp, coalesce(f.proof_sha256, sha256('')) AS proof_sha256,
         list_reduce([[coalesce(p.tampered, p.leaf), '']] || coalesce(f.path, []), lambda node, step: [sha256(step[1] || node[1] || step[2]), ''])[1] AS folded_root
  FROM placed p LEFT JOIN proofs f ON f.doc_id = p.doc_id AND f.leaf = p.leaf
)
SELECT f.doc_id, f.leaf, s.subroot, h.hash AS root, f.proof_sha256, f.folded_root, f.folded_root = h.hash AS verified
FROM folds f JOIN subroots s ON s.grp = f.grp JOIN high h ON h.n = 1
"""
