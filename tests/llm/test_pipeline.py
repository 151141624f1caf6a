"""The pipeline's stages, each against brute force on its own input."""

from llm_rows import hard, nothing  # noqa: F401
from test_edited_copies import brute_kept
from test_others import brute_digest, reference  # noqa: F401
from test_text_dedup import brute_exact

from pyspark.sql import functions as F

import corpus_pipeline
from schedlake.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path, reference):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        if at + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    assert list(kept) == ["quality_classifier", "exact_dedup", "simhash_dedup", "mixing", "byte_bpe"]

    before, after = kept["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after} == good and set(after) <= set(before)
    taught = {r.doc_id: r.quality for r in labels.collect()}
    clean = [i for i, q in taught.items() if q == 1]
    assert sum(i in good for i in clean) / len(clean) > 0.95

    before, after = kept["exact_dedup"]
    assert {r.doc_id for r in after} == {i for i, _, _, stays, _ in brute_exact([(r.doc_id, r.text) for r in before]) if stays}

    before, after = kept["simhash_dedup"]
    assert sorted(r.doc_id for r in after) == brute_kept([(r.doc_id, r.text) for r in before])

    before, after = kept["mixing"]
    ids = [r.doc_id for r in after]
    assert set(ids) <= {r.doc_id for r in before} and max(map(ids.count, set(ids))) <= 2
    words = {r.doc_id: len(r.text.encode().split()) for r in before}
    total = sum(words.values())
    assert abs(sum(words[i] for i in ids) - 1.5 * total) < 0.2 * total

    before, after = kept["byte_bpe"]
    assert sorted(map(tuple, after)) == sorted((r.doc_id, *brute_digest(reference, r.text)) for r in before)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_hard_rows_and_nothing(spark, hard, nothing):  # noqa: F811
    for docs in (hard[0], nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count()


def test_repeated_ids_and_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (None, "c"), (4, "C"), (4, "d e f g h i"), (4, "d e f g h i"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    long = whole.orderBy("doc_id").limit(1).select(F.lit(1).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    asked = docs.unionByName(long)
    scored = quality.scored(asked.withColumn("own", F.col("text")), spark.read.parquet(f"{SF}/labels.parquet"), keep=("own",)).collect()
    want = sorted((str(r.doc_id), r.own or "") for r in scored if r.predicted)
    assert sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.good(spark, asked, SF).collect()) == want
    kept = corpus_pipeline.exact(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, "b"), (2, "a"), (4, "C"), (4, "d e f g h i")]
    kept = corpus_pipeline.near(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, ""), (1, "a"), (1, "b"), (3, "c"), (4, "d e f g h i")]
    taken = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in taken} <= set(rows)
