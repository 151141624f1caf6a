"""Mixing, sharding, classifier, embeddings, languages and BPE."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from llm_rows import hard, nothing  # noqa: F401
from pyspark.sql import functions as F

from schedlake.llm import bpe, embedding_dedup, language_id, mixing, quality, sharding
from tools.parity import duck, rows_of

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# -- mixing --------------------------------------------------------------------


def test_mixing_hard_rows(spark, hard, nothing):
    docs, rows = hard
    assert mixing.mixed_sizes(nothing, [3, 1, 2], 1.5, 2).count() == 0
    got = mixing.mixed_sizes(docs, [3, 1, 2], 1.5, 2).collect()
    assert len(got) == len(rows)
    by_source = {}
    place = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by_source.setdefault(place[r.doc_id], [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] += r["size"]
    for taken, target, size, total in by_source.values():
        assert size == total and abs(taken - target) <= 1 and target <= 2 * size
    assert math.isclose(sum(s[1] for s in by_source.values()), 1.5 * sum(s[2] for s in by_source.values()))


def test_mixing_reruns_agree(hard):
    docs, _ = hard
    once = sorted(map(tuple, mixing.mixed_sizes(docs, [3, 1, 2], 1.5, 2).collect()))
    again = sorted(map(tuple, mixing.mixed_sizes(docs.repartition(5), [3, 1, 2], 1.5, 2).collect()))
    assert once == again


def test_mixing_follows_the_tree(spark, hard, monkeypatch):
    """Words by shard equal those of the SQL check's own tree, on rows with nulls, repeats and a very long text."""
    docs, rows = hard
    got = sorted(tuple(map(str, r)) for r in mixing.mixed_sizes(docs, [3, 1, 2], 1.5, 2).select("doc_id", "taken", "shard_words").collect())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[3] for r in rows]}))
    want = con.execute(f"SELECT doc_id, taken, shard_words FROM ({mixing.OP1_SQL})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)
    shards = [sum(int(r[2].split(",")[k]) for r in got) for k in range(8)]
    assert all(sum(map(int, r[2].split(","))) == int(r[1]) for r in got) and max(shards) - min(shards) <= 256 * 5
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, n, seed: tree(quotas, n, seed + 1))
    other = mixing.mixed_sizes(docs, [3, 1, 2], 1.5, 2).select("doc_id", "taken", "shard_words").collect()
    assert sorted(tuple(map(str, r)) for r in other) != got


def test_mixed_documents_of_repeated_ids(spark):
    rows = [(1, "a b c d", "s"), (1, "e", "s"), (1, None, "s"), (1, "e", "s"), (None, "f g", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs, [1], 2.0, 2).collect()
    assert sorted(r.text for r in got) == sorted(["a b c d", "e", "e", "f g"] * 2)


def test_splitting_tree(spark):
    rows = [("a", 400), ("b", 37), (None, 5), ("c", 0), ("d", 1)]
    quotas = spark.createDataFrame(rows, "source string, blocks long")
    dealt = {r.source: list(r.first) for r in mixing.splitting_tree(quotas, 8, 11).collect()}
    loads = [0] * 8
    for source, n in rows:
        first = dealt[source]
        assert first[0] == 0 and first[-1] == n and first == sorted(first)
        for k in range(8):
            loads[k] += first[k + 1] - first[k]
    assert max(loads) - min(loads) <= 1


def test_hypergeometric_mean_and_range(spark):
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    x = [r.x for r in u.select(F.expr(mixing.hypergeometric("60", "25", "30", "u")).alias("x")).collect()]
    assert min(x) >= 0 and max(x) <= 25
    assert abs(np.mean(x) - 12.5) < 0.05 and abs(np.var(x) - 30 * 25 / 60 * 35 / 60 * 30 / 59) < 0.1


def test_mixed_documents(hard):
    docs, rows = hard
    got = mixing.mixed_documents(docs, [3, 1, 2], 1.5, 2)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert max(map(ids.count, ids)) <= 2


# -- sharding ------------------------------------------------------------------


def check_shards(got, rows):
    assert len(got) == len(rows)
    counts = [sum(r.shard == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_sharding(spark, hard, nothing):
    docs, rows = hard
    assert sharding.sharded(nothing).count() == 0
    check_shards(sharding.sharded(docs).collect(), rows)


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"group {i % 40}" if i < 200 else f"own {i}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.sharded(docs).collect()
    check_shards(got, rows)
    where = {}
    for r in got:
        where.setdefault(dict(rows)[r.doc_id], []).append(r.shard)
    groups = [v for k, v in where.items() if k.startswith("group")]
    whole = sum(max(map(v.count, v)) for v in groups) / sum(map(len, groups))
    assert whole > 0.8  # a hash would leave about a third with the largest part


# -- classifier ----------------------------------------------------------------


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 30
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_classifier_edges(spark, hard, nothing):
    docs, rows = hard
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(9999, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, some).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(nothing, some).count() == 0


def test_held_out_rows_do_not_teach(spark, hard):
    docs, rows = hard
    labels = [(r[0], i % 2, 0) for i, r in enumerate(rows)]
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted(map(tuple, quality.scored(docs, spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b


# -- embeddings ----------------------------------------------------------------


def brute_vectors(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for a, (i, v) in enumerate(ok):
        for j, w in ok[:a]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    low = {}
    for i, _ in rows:
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        low[i] = min(seen)
    return sorted((i, len(links[i]), low[i], low[i] == i) for i, _ in rows)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append(centre + rng.standard_normal(16) * 0.12)
    dense = rng.standard_normal(16)
    rows += [dense + rng.standard_normal(16) * 0.05 for _ in range(150)]
    rows += [rows[0]] * 20
    rows = [(i * 7 % 1009, np.float32(v).tolist()) for i, v in enumerate(rows)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [math.nan] * 16), (2004, [math.inf, *[1.0] * 15]), (2005, [None, *[1.0] * 15]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect())
    assert got == brute_vectors(rows)


def test_embeddings_groups_joined_by_one_link(spark):
    """Two groups whose lists are full of their own members, and one pair between them that links; double precision."""
    r = np.random.default_rng(3)
    a, o = np.eye(48)[:2]
    turn = lambda x: np.cos(x) * a + np.sin(x) * o
    apart = math.acos(0.86)
    groups = [c + 0.28 * r.standard_normal((40, 48)) / math.sqrt(48) for c in (a, turn(apart))]
    bridge = [turn(apart / 2 - 0.19), turn(apart / 2 + 0.19)]
    x = np.concatenate([*groups, bridge, r.standard_normal((40, 48)), [1e300 * a, 1e-300 * a]])
    ids = r.permutation(len(x))
    largest = np.abs(x).max(1, keepdims=True)
    unit = x / largest / np.linalg.norm(x / largest, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    low = ids.copy()
    for _ in range(len(x)):
        low = np.minimum(low, np.where(near, low[None, :], len(x)).min(1))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect())
    assert got == sorted(zip(ids.tolist(), near.sum(1).tolist(), low.tolist()))


def test_embeddings_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- languages -----------------------------------------------------------------


def test_languages_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_edges(spark, hard, nothing):
    docs, rows = hard
    assert language_id.identify(nothing, nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    got = {r.doc_id: r for r in language_id.identify(docs, docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, t, *_ in rows:
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)), (i, t)


def test_kneser_ney_is_a_distribution():
    counts = {}
    text = "   banana bandana ananas nab "
    for i in range(3, len(text)):
        counts[text[i - 3 : i + 1]] = counts.get(text[i - 3 : i + 1], 0) + 1
    model = language_id.KneserNey(counts)
    alphabet = sorted(set("".join(counts)))
    for context in ("ban", "ana", " ba", "zzz"):
        grams = np.array([[*map(ord, context), ord(c)] for c in alphabet])
        total = np.exp(model.log_probability(grams)).sum()
        assert 0.9 < total <= 1.0001  # the rest is kept for unseen characters


# -- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_digest(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_on_hard_rows(hard, nothing, reference):
    docs, rows = hard
    got = sorted(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()))
    assert got == sorted((r[0], *brute_digest(reference, r[1])) for r in rows)
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_table(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op10_byte_bpe(spark, SF).collect():
        assert tuple(r)[1:] == brute_digest(reference, texts[r.doc_id])


def test_codec_on_random_text(reference):
    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(4)
    pool = ["a", "b", "the", "  ", " ", "\n", "\t", "é", "ß", "日", "本", "🙂", "́", "‍", " ", "\x1c", "\x85", "1", "½", "'s", "'LL", "!!", "\x00", "aaaaaaaa", "İ"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    ids = codec.encode(texts)
    assert ids == [reference.encode_ordinary(t) for t in texts]
    for t, x in zip(texts, ids):
        assert codec.decode(x) == t.encode()
        assert all(0 <= s < len(t) for s in codec.starts(x)) and codec.starts(x) == sorted(codec.starts(x))


def test_decode_splits_characters(spark):
    tokens = bpe.encode(spark.createDataFrame([(1, "日本語 🙂"), (2, None)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    whole = {r.doc_id: (bytes(r.bytes), r.text) for r in bpe.decode(tokens, RANKS, public_tokenizers.PATTERN).collect()}
    assert whole == {1: ("日本語 🙂".encode(), "日本語 🙂"), 2: (b"", "")}
    cut = tokens.withColumn("ids", F.slice("ids", 1, F.size("ids") - 1)).filter("doc_id = 1")
    assert bpe.decode(cut, RANKS, public_tokenizers.PATTERN).first().text.endswith("�")


# -- registered queries with SQL ------------------------------------------------


@pytest.mark.parametrize("name", ["op1_mixing", "op2_substring_dedup", "op3_exact_dedup", "op6_embedding_dedup", "op7_line_dedup"])
def test_sql(spark, name):
    from schedlake.llm.queries import CHECKS, QUERIES

    df = QUERIES[name](spark, SF)
    cols, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(CHECKS[name])
    assert (cols, rows) == rows_of([d[0] for d in cur.description], cur.fetchall())
