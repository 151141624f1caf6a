"""The near-duplicate stage of the pipeline against all pairs of 5-word shingles."""

import random
import re

import corpus_pipeline
from schedlake.llm import edited_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "doc_id long, text string"


def brute_kept(rows):
    """Ids that stay: the smallest of each group of texts with a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    low = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if low[i] != low[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return sorted(i for (i, _), x in zip(rows, low) if i == x)


def edited(r, text, n):
    words = list(text)
    for at in r.sample(range(len(words)), n):
        words[at] = f"edit{r.randint(0, 10**9)}"
    return words


def test_edited_copies_leave(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in range(12):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        texts += [base, *(edited(r, base, max(1, len(base) // k)) for k in (300, 100, 60, 40, 20, 10))]
    hot = [r.choice(words) for _ in range(150)]
    texts += [edited(r, hot, r.randint(1, 5)) for _ in range(60)]
    ids = r.sample(range(1000), len(texts) + 5)
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts)] + list(zip(ids[len(texts) :], [None, "", "one two", "ONE two", "one two three"]))
    want = brute_kept(rows)
    assert len(want) < len(rows) - 80
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, FIELDS).repartition(3), "")
    assert sorted(x.doc_id for x in got.collect()) == want


def test_near_stage_on_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = corpus_pipeline.near(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert sorted(x.doc_id for x in got.collect()) == brute_kept(rows)


def test_groups_that_only_blocks_can_join(spark, monkeypatch):
    """One bucket-sharing crowd in which few pairs link: neither neighbours nor single rows of groups decide it."""
    monkeypatch.setattr(edited_copies, "BLOCK", 16)
    monkeypatch.setattr(edited_copies, "PART", 20)
    r = random.Random(8)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    crowd = []
    for _ in range(70):  # edits at places spread over the text: about 0.7 alike
        words = list(base)
        for at in range(r.randint(0, 3), 120, 32):
            words[at] = f"e{r.randint(0, 10**9)}"
        crowd.append(words)
    bridges = [edited(r, crowd[i], 1) for i in range(0, 70, 9)] + [crowd[3][:60] + crowd[40][60:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(crowd + bridges)]
    r.shuffle(rows)
    want = brute_kept(rows)
    assert 5 < len(want) < len(rows) - 5
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, FIELDS).repartition(3), "")
    assert sorted(x.doc_id for x in got.collect()) == want
