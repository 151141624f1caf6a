"""Operator 4: sharding by balanced label propagation.

Documents hang together through hubs: rows (key, hub) say that documents with the same hub belong together, such as equal
texts. Linked documents start at a shard that a hash gives. In each round a hub votes for the shard that holds most of its
documents, every document asks to move to the shard with most votes, and moves are granted under quotas: what two shards
exchange, plus what free capacity allows. Votes and requests are grouped sums and equality joins; only the shards-by-shards
table of requests is seen by the driver.

The law is ``rows``: counts at most one apart. After the last round each shard keeps as many linked documents as its target
allows; the rest and the documents without links fill the shards up in one ranked pool. A group larger than a shard is
therefore split, any other stays whole but for the edges of quotas.

Null texts have size 1 (no bytes plus 1), the CRC of no bytes, and no links. Repeated rows and null ids are rows of their
own. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle, spread_rank

SHARDS, ROUNDS = 8, 6


def equal_texts(rows: DataFrame) -> DataFrame:
    """(key, hub) for texts that occur more than once, from (key, digest)."""
    again = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(again, "digest", "left_semi").select("key", F.col("digest").alias("hub"))


def granted(requests: dict[tuple[int, int], int], held: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the requested moves (from, to) keep every shard within its capacity: exchanges, then free places."""
    out = {ft: min(n, requests.get((ft[1], ft[0]), 0)) for ft, n in requests.items()}
    free = {k: max(0, capacity[k] - held.get(k, 0)) for k in capacity}
    for (f, t), n in sorted(requests.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[f, t], free[t])
        out[f, t] += more
        free[t] -= more
        free[f] += more
    return out


def propagate(links: DataFrame, capacity: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """(key, shard) for every linked document."""
    shards = len(capacity)
    state = settle(links.select("key").distinct().withColumn("shard", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(shards)).cast("int")))
    for turn in range(rounds):
        tally = links.join(state, "key").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        votes = tally.groupBy("hub").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("v")).select("hub", "v.n", "v.shard")
        wished = links.join(votes, "hub").groupBy("key", "shard").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max(F.struct("n", "shard")).alias("w")).select("key", F.col("w.shard").alias("wish"))
        asked = settle(state.join(wished, "key"))
        table = asked.groupBy("shard", "wish").agg(F.count(F.lit(1)).alias("n")).collect()  # shards times shards at most
        requests = {(r["shard"], r["wish"]): r["n"] for r in table if r["shard"] != r["wish"]}
        held = {k: sum(r["n"] for r in table if r["shard"] == k) for k in capacity}
        allowed = granted(requests, held, capacity)
        shares = {ft: n / requests[ft] for ft, n in allowed.items() if n}
        if not shares:
            break
        # the granted share of the requests between two shards, picked by a hash
        chance = F.coalesce(F.element_at(F.create_map(*[x for (f, t), s in shares.items() for x in (F.lit(f * shards + t), F.lit(s))]), F.col("shard") * shards + F.col("wish")), F.lit(0.0))
        drawn = F.pmod(F.xxhash64("key", F.lit(100 + turn)), F.lit(1 << 30)) / float(1 << 30)
        state = settle(asked.select("key", F.when(drawn < chance, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
    return state


def sharded(docs: DataFrame, shards: int = SHARDS, hubs=equal_texts) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``hubs`` makes (key, hub) from (key, digest); ``key`` numbers the rows.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = settle(docs.select("doc_id", "text").select(
        F.monotonically_increasing_id().alias("key"), "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.sha2(raw, 256)).alias("digest"),
    ))
    total = rows.count()
    capacity = {k: total // shards + (k < total % shards) for k in range(shards)}
    state = propagate(settle(hubs(rows)), capacity)
    placed = settle(rows.drop("digest").join(state, "key", "left").withColumn("wish", F.coalesce("shard", F.lit(-1))).drop("shard"))
    ranked = settle(spread_rank(placed, ["wish"], "key", "rank"))
    target = F.element_at(F.array(*[F.lit(n) for n in capacity.values()]), F.greatest(F.col("wish"), F.lit(0)) + 1)
    marked = ranked.withColumn("stays", (F.col("wish") >= 0) & (F.col("rank") < target))
    kept = {r["wish"]: r["n"] for r in marked.filter("stays").groupBy("wish").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per shard
    bounds, begin = [], 0
    for k, n in capacity.items():
        bounds.append((begin, kept.get(k, 0)))
        begin += n - kept.get(k, 0)
    stay = marked.filter("stays").select("doc_id", "size", "text_crc32", F.col("wish").alias("shard"), F.col("rank").alias("slot"))
    pool = spread_rank(settle(marked.filter("NOT stays").drop("rank").withColumn("one", F.lit(0))), ["one"], "key", "rank")
    firsts = F.array(*[F.lit(b) for b, _ in bounds])
    shard = F.size(F.filter(firsts, lambda b: b <= F.col("rank")))
    begin_of, stays_of = F.element_at(firsts, F.col("shard")), F.element_at(F.array(*[F.lit(n) for _, n in bounds]), F.col("shard"))
    filled = pool.withColumn("shard", shard).select("doc_id", "size", "text_crc32", (F.col("shard") - 1).alias("shard"), (F.col("rank") - begin_of + stays_of).alias("slot"))
    return stay.unionByName(filled).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
