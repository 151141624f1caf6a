"""Operator 1: mixing sources to target weights, with DataFrame functions only.

The documents of a source are put into a random but repeatable order (MD5 of seed and id); its words then form one stream,
read again from its start where the target exceeds the source, and cut into blocks of ``block_words``. A source's quota is
the number of blocks that cover its target. A multivariate-hypergeometric splitting tree deals the quotas out: every
node splits its blocks into halves of equal number, drawing how many come from which source without replacement, until a
leaf is one output shard; the draws invert an MD5 of seed and node. Shard k then owns, per source, the blocks after those of shards 0 .. k-1: disjoint, and random as
the stream is. Rows of a shard are shuffled locally by a hash. Counts per source are exact whatever the draws.

Order positions come from two levels, hash buckets of about ``BUCKET_ROWS`` rows and running sums over the buckets, so
no task sees a whole source. One row per source and per tree node is all that is held together (sources times shards).

Null texts and texts without a word have size 0 and are never drawn. A null source is a source of its own, ordered last.
Rows that repeat an id are separate documents; ties are broken by id and size, so equal rows are interchangeable. An empty
table gives no rows. Only id, text and source are read, other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.llm.common import WORD, documents, free_name, row_name, settle

BUCKET_ROWS = 1000
BLOCK_WORDS = 256
SHARDS = 8


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) and the columns ``keep``: words of each text."""
    return docs.select(
        *keep, "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(by_source: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add weight and target to (source, source_size, n): weights repeat over the sources in code point order, null last.

    Targets share ``share`` of all sizes by weight, stop at ``most`` times the source, and the excess is shared again
    until none is above. Sources that stop are those with the smallest size per weight, so one running sum over the
    sources finds the level. The windows run over one row per source.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    before = Window.orderBy(F.col("source_size") * F.lit(float(most)) / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return leveled.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.col("level"))).drop("level")


def _ln_factorial(n: str) -> str:
    """SQL for the logarithm of n!: the exact factorial up to 20, Stirling's series beyond."""
    x = f"double(greatest({n}, 1))"
    return (
        f"if({n} <= 20, ln(factorial(int(least(greatest({n}, 0), 20)))),"
        f" {x} * ln({x}) - {x} + ln({x} * {2 * math.pi!r}D) / 2 + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}))"
    )


def hypergeometric(total: str, of_kind: str, drawn: str, u: str) -> str:
    """SQL for how many of ``drawn`` blocks, taken out of ``total`` without replacement, are among ``of_kind``.

    Inverts the distribution for a uniform ``u``, walking outwards from the most likely count; the walk covers more than
    twelve standard deviations on both sides. The arguments are SQL expressions without side effects.
    """

    def choose(n: str, k: str) -> str:
        return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"

    # the numbers of this draw, as fields of p; each step reads them from its own state
    low, high = f"bigint(greatest(0, {drawn} + {of_kind} - {total}))", f"bigint(least({drawn}, {of_kind}))"
    mode = f"least(greatest(bigint(floor((double({drawn}) + 1) * ({of_kind} + 1) / ({total} + 2))), {low}), {high})"
    share = f"(double({of_kind}) / greatest({total}, 1))"
    spread = f"bigint(ceil(12 * sqrt(double({drawn}) * {share} * (1 - {share})) + 12))"
    p_mode = f"exp({choose('p.k', 'p.m')} + {choose('(p.t - p.k)', '(p.n - p.m)')} - {choose('p.t', 'p.n')})"
    numbers = f"named_struct('t', bigint({total}), 'k', bigint({of_kind}), 'n', bigint({drawn}), 'u', double({u}), 'lo', {low}, 'hi', {high}, 'm', {mode})"
    start = (
        f"transform(array({numbers}), p -> named_struct('t', p.t, 'k', p.k, 'n', p.n, 'lo', p.lo, 'hi', p.hi, 'm', p.m, 'up', p.m, 'down', p.m,"
        f" 'p_up', {p_mode}, 'p_down', {p_mode}, 'u', p.u - {p_mode}, 'x', if(p.u < {p_mode}, p.m, bigint(null))))[0]"
    )
    p_up = "if(s.up < s.hi, s.p_up * (s.k - s.up) * (s.n - s.up) / ((s.up + 1) * double(s.t - s.k - s.n + s.up + 1)), 0D)"
    p_down = "if(s.down > s.lo, s.p_down * s.down * (s.t - s.k - s.n + s.down) / ((s.k - s.down + 1) * double(s.n - s.down + 1)), 0D)"
    step = (
        "named_struct('t', s.t, 'k', s.k, 'n', s.n, 'lo', s.lo, 'hi', s.hi, 'm', s.m, 'up', least(s.up + 1, s.hi), 'down', greatest(s.down - 1, s.lo),"
        f" 'p_up', {p_up}, 'p_down', {p_down}, 'u', s.u - {p_up} - {p_down},"
        f" 'x', coalesce(s.x, if(s.u < {p_up}, s.up + 1, if(s.u < {p_up} + {p_down}, s.down - 1, bigint(null)))))"
    )
    steps = f"sequence(1, int(greatest(1, least({high} - {low}, {spread}))))"
    return f"aggregate({steps}, {start}, (s, i) -> {step}, s -> coalesce(s.x, s.m))"


def uniform(parts: str) -> str:
    """SQL for a number from 0 up to 1 that the MD5 of the values gives, the same in every engine."""
    return f"(double(conv(substring(md5(concat_ws(':', {parts})), 1, 13), 16, 10)) / {float(1 << 52)}D)"


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal (source, blocks) out to ``shards`` (a power of two): (source, first array<long>), where first[k] is the first
    block of shard k and first[shards] the number of blocks."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "blocks"))).alias("q")).select(
        F.lit(0).alias("node"), F.transform("q", lambda x: x["source"]).alias("sources"), F.transform("q", lambda x: x["blocks"]).alias("blocks"),
    )
    for level in range(shards.bit_length() - 1):
        total = "aggregate(blocks, 0L, (a, x) -> a + x)"
        odd = f"floor(2 * {uniform(f'{seed}, {level}, node')})"
        drawn = hypergeometric("d.left", "x", "d.draw", uniform(f"{seed}, {level}, node, size(d.taken)"))
        half = f"""aggregate(blocks,
          named_struct('left', {total}, 'draw', bigint(floor(({total} + {odd}) / 2)), 'taken', cast(array() as array<bigint>)),
          (d, x) -> transform(array({drawn}), c -> named_struct('left', d.left - x, 'draw', d.draw - c, 'taken', concat(d.taken, array(c))))[0],
          d -> d.taken)"""
        split = nodes.withColumn("half", F.expr(half))
        # written out between levels: each level's expression refers to the one before many times
        nodes = settle(split.select(
            F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("half").alias("blocks")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("blocks", "half", lambda b, h: b - h).alias("blocks")),
            )).alias("child"), "sources",
        ).select("child.node", "sources", "child.blocks"))
    leaves = nodes.select("node", F.explode(F.arrays_zip("sources", "blocks")).alias("x")).select("node", F.col("x.sources").alias("source"), F.col("x.blocks").alias("blocks"))
    per_source = leaves.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "blocks"))), lambda x: x["blocks"]).alias("dealt"))
    running = F.aggregate("dealt", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return per_source.select("source", running.alias("first"))


def positions(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``begin``: words of the source before the document in the permuted order."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # as many buckets for every source as the table has BUCKET_ROWS: nothing deals the rows by source alone
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    share = F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = sized.withColumn("mark", mark).withColumn("bucket", F.floor(share * buckets).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket")))
        .withColumn("begin", F.col("begin") + F.col("offset")).drop("__source", "__bucket", "bucket", "offset", "mark")
    )


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, most: float = 2.0, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 42, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target, begin and the columns ``keep``; draws).

    ``draws`` has a row per drawn part of a document: doc_id, source, shard, block, word_from, word_to (of the document's
    words) and slot_key, the order within the shard. A document on the edge between blocks is drawn in parts; one drawn
    twice has two rows with the same words.
    """
    sized = settle(sizes(docs, keep))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = settle(targets(by_source, weights, share, most).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")))
    quotas = goals.filter("goal > 0").select("source", F.ceil(F.col("goal") / block_words).cast("long").alias("blocks"))
    dealt = splitting_tree(quotas, shards, seed)
    plan = settle(goals.select(F.col("source").alias("__source"), "source_size", "target", "goal").join(
        dealt.withColumnRenamed("source", "__s"), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    placed = settle(positions(sized, seed).join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    passes = placed.filter("size > 0 and goal > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    here = F.col("begin") + F.col("lap") * F.col("source_size")
    cut = passes.withColumn("at", here).filter("at < goal").withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("goal")))
    parts = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("stop") - 1) / block_words))))
    lo, hi = F.greatest(F.col("block") * block_words, F.col("at")), F.least((F.col("block") + 1) * block_words, F.col("stop"))
    draws = parts.select(
        "doc_id", "source", (F.size(F.filter("first", lambda f: f <= F.col("block"))) - 1).alias("shard"), "block",
        (lo - F.col("at")).alias("word_from"), (hi - F.col("at")).alias("word_to"), F.xxhash64(F.lit(seed), "source", "block").alias("slot_key"),
        "begin",
    )
    return placed.drop("first", "goal"), draws


def mixed_sizes(docs: DataFrame, weights: list[float], share: float, most: float, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (drawn words, repeats counted) and shard_words, the
    drawn words by output shard, joined by commas (``0,0,..`` for a document that is not drawn)."""
    placed, draws = mix(docs, weights, share, most, shards=shards, seed=seed)
    words = F.col("word_to") - F.col("word_from")
    here = [F.coalesce(F.sum(F.when(F.col("shard") == k, words)), F.lit(0)) for k in range(shards)]
    taken = draws.groupBy("doc_id", "source", "begin").agg(F.sum(words).alias("taken"), F.concat_ws(",", *[x.cast("string") for x in here]).alias("shard_words"))
    # (source, begin) is unique among documents with words; it stands for the row where ids repeat or are null
    keys = taken.select(F.col("source").alias("__source"), F.col("begin").alias("__begin"), "taken", "shard_words")
    joined = placed.join(keys, F.col("source").eqNullSafe(F.col("__source")) & (F.col("begin") == F.col("__begin")) & (F.col("size") > 0), "left")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shard_words", F.lit(",".join("0" * shards))).alias("shard_words"),
    )


def mixed_documents(docs: DataFrame, weights: list[float], share: float, most: float, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole and once per lap in which at least half of their words are drawn.
    Rows that repeat an id are told apart by text and source; rows equal in all three are taken alike, as often as the most drawn."""
    key = free_name(docs, "row_key")
    rows = docs.withColumn(key, row_name("doc_id", "text", "source"))
    placed, draws = mix(rows, weights, share, most, seed=seed, keep=(key,))
    laps = draws.groupBy("source", "begin").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    times = laps.join(placed.select(F.col("source").alias("__source"), F.col("begin").alias("__begin"), "size", key).filter("size > 0"),
                      F.col("source").eqNullSafe(F.col("__source")) & (F.col("begin") == F.col("__begin")))
    number, lap = (free_name(docs, x) for x in ("times", "lap"))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    wanted = times.groupBy(key).agg(F.max(copies).alias(number)).filter(F.col(number) > 0)
    repeated = rows.join(wanted, key).withColumn(lap, F.explode(F.sequence(F.lit(1), F.col(number))))
    return repeated.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir), weights=[3, 1, 2], share=1.5, most=2)


OP1_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents
), g AS (
  SELECT source, sum(size)::DOUBLE AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM s GROUP BY source
), l AS (
  SELECT *, ((sum(n) OVER ()) * 1.5 - coalesce(sum(n) OVER b, 0) * 2) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS level
  FROM g WINDOW b AS (ORDER BY n * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, n, least(n * 2, w * max(level) OVER ()) AS target FROM l
), z AS (
  SELECT source, ceil(floor(target + 0.5) / 256)::BIGINT AS blocks, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM t WHERE floor(target + 0.5) > 0
), tree (level, node, blocks, half, place) AS (
  -- a step draws one source of a node without replacement; the last one makes the two children
  SELECT 0, 0::BIGINT, list(blocks ORDER BY idx), []::BIGINT[], 1 FROM z
  UNION ALL
  SELECT CASE WHEN place <= len(blocks) THEN level ELSE level + 1 END, CASE WHEN place <= len(blocks) THEN node ELSE node * 2 + side END,
    CASE WHEN place <= len(blocks) THEN blocks WHEN side = 0 THEN half ELSE list_transform(range(1, len(blocks) + 1), lambda i: blocks[i] - half[i]) END,
    CASE WHEN place <= len(blocks) THEN list_append(half, (walk[list_filter(range(1, len(walk) + 1), lambda i: list_sum(list_transform(walk[1:i], lambda y: y.p)) > u)[1]]).k) ELSE [] END,
    CASE WHEN place <= len(blocks) THEN place + 1 ELSE 1 END
  FROM (
    -- the possible counts from the likeliest one outwards, with their probabilities
    SELECT *, list_sort(list_transform(range(greatest(0, d + c - a), least(c, d) + 1), lambda k: {
      'turn': CASE WHEN k > m THEN 2 * (k - m) - 1 ELSE 2 * (m - k) END,
      'k': k, 'p': exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + lgamma(a - c + 1) - lgamma(d - k + 1) - lgamma(a - c - d + k + 1) - lgamma(a + 1) + lgamma(d + 1) + lgamma(a - d + 1))})) AS walk
    FROM (
      SELECT *, least(greatest(floor((d + 1.0) * (c + 1) / (a + 2))::BIGINT, greatest(0, d + c - a)), least(c, d)) AS m
      FROM (
        SELECT level, node, blocks, half, place, side, coalesce(blocks[place], 0) AS c, list_sum(blocks)::BIGINT - coalesce(list_sum(blocks[1:place - 1]), 0)::BIGINT AS a,
          floor((list_sum(blocks) + floor(2 * (('0x' || substr(md5('42:' || level || ':' || node), 1, 13))::BIGINT / 4503599627370496.0))) / 2)::BIGINT - coalesce(list_sum(half), 0)::BIGINT AS d,
          ('0x' || substr(md5('42:' || level || ':' || node || ':' || (place - 1)), 1, 13))::BIGINT / 4503599627370496.0 AS u
        FROM tree, (VALUES (0), (1)) v(side) WHERE level < 3 AND (place > len(blocks) OR side = 0)
      )
    )
  )
), first AS (
  SELECT source, node, tree.blocks[idx] AS dealt, sum(tree.blocks[idx]) OVER (PARTITION BY idx ORDER BY node) * 256 AS stop FROM tree, z WHERE tree.level = 3
), p AS (
  SELECT s.doc_id, s.size, s.source, t.n, t.target, floor(t.target + 0.5) AS goal, row_number() OVER () AS r,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), h AS (
  SELECT r, string_agg((greatest(0, least(begin + size, goal, stop) - greatest(begin, stop - dealt * 256)) + greatest(0, least(begin + n + size, goal, stop) - greatest(begin + n, stop - dealt * 256)))::BIGINT::VARCHAR, ',' ORDER BY node) AS shard_words
  FROM p JOIN first ON p.source IS NOT DISTINCT FROM first.source GROUP BY r
)
SELECT doc_id, size, n::BIGINT AS source_size, target,
  (greatest(0, least(size, goal - begin)) + greatest(0, least(size, goal - begin - n)))::BIGINT AS taken, coalesce(shard_words, '0,0,0,0,0,0,0,0') AS shard_words
FROM p LEFT JOIN h USING (r)
"""
