"""Exact, SimHash, substring and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_rows import hard, nothing  # noqa: F401

from schedlake.llm import exact_dedup, line_dedup, simhash_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


# -- exact ---------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    return sorted((i, max(groups[k]), len(groups[k]), i == max(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for k, ids in groups.items() for i in ids)


def test_exact_on_hard_rows(hard):
    docs, rows = hard
    got = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert got == brute_exact([(r[0], r[1]) for r in rows])


def test_exact_empty_and_null_ids(spark, nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (None, "b"), (4, "c"), (4, "c")], "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == [("3", 3, 3, True), ("4", 4, 2, True), ("4", 4, 2, True), ("None", 3, 3, False), ("None", 3, 3, False), ("None", None, 1, True)]


def test_quotient_filters_lose_nothing(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    values += values[:400] + values[:100] * 3
    fps = spark.createDataFrame([(v,) for v in values], "fp long").repartition(7)
    for bits in (0, 1, 5, 11):
        got = {r.fp: r.n for r in exact_dedup.repeated_fingerprints(exact_dedup.quotient_filters(fps, bits), bits).collect()}
        want = {v: values.count(v) for v in set(values[:400])}
        assert got == want


# -- SimHash -------------------------------------------------------------------


def brute_fingerprint(text, width=3):
    words = WORD.findall(ascii_lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_near(rows, width=3, threshold=2):
    fps = np.array([brute_fingerprint(t, width) for _, t in rows], np.uint64)
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= threshold):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((doc, f"{int(fps[i]):016x}", low[root(i)]) for i, (doc, _) in enumerate(rows))


def test_simhash_on_hard_rows(hard):
    docs, rows = hard
    got = sorted(map(tuple, simhash_dedup.near_groups(docs).collect()))
    assert got == brute_near([(r[0], r[1]) for r in rows])


def test_simhash_on_table(spark):
    rows = table(spark)
    got = sorted(map(tuple, simhash_dedup.op8_simhash_dedup(spark, SF).collect()))
    assert got == brute_near(rows)


def test_simhash_empty(nothing):
    assert simhash_dedup.near_groups(nothing).count() == 0


def test_golay_code_is_perfect():
    patterns, counts = simhash_dedup.covering(2)[0]
    assert (counts == 1).all()
    assert sum(len(np.unique(p[:, :1])) > 0 for p, _ in simhash_dedup.covering(2)) == 3


@pytest.mark.parametrize("threshold", [1, 2])
def test_covering_finds_every_pair(spark, threshold):
    rng = np.random.default_rng(threshold)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, threshold + 2), replace=False)) for b in base for _ in range(6)]
    dense = [int(base[0]) ^ (1 << i) for i in range(40)]  # all within two bits of each other
    fps = sorted({np.uint64(x).astype(np.int64).item() for x in [*base.tolist(), *near, *dense]})
    got = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4), threshold).collect()
    arr = np.array(fps)
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in got:
        a, b = root(r.a), root(r.b)
        label[max(a, b)] = min(a, b)
    want = {f: f for f in fps}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    for f in fps:
        for g in arr[np.bitwise_count((arr ^ f).view(np.uint64)) <= threshold]:
            a, b = top(f), top(int(g))
            want[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == {f: top(f) for f in fps}


# -- substrings ----------------------------------------------------------------


def brute_removed(rows, window=50):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def test_substrings_on_hard_rows(hard):
    docs, rows = hard
    assert sorted(map(tuple, substring_dedup.removed_words(docs).collect())) == brute_removed([(r[0], r[1]) for r in rows])


def test_substrings_on_table(spark):
    assert sorted(map(tuple, substring_dedup.op2_substring_dedup(spark, SF).collect())) == brute_removed(table(spark))


@pytest.mark.parametrize("group", [0, 2000])
def test_crowded_prefixes(spark, monkeypatch, group):
    """A very frequent line in many contexts, with prefixes lengthened to the whole window or not."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    r = random.Random(group)
    words = [f"w{i}" for i in range(200)]
    line = "the line that stands in very many texts of this table".split()
    bodies = [[r.choice(words) for _ in range(90)] for _ in range(6)]
    rows = []
    for i in range(60):
        body = list(bodies[i % 6]) if i % 2 else [r.choice(words) for _ in range(90)]
        at = r.randint(0, 90)
        rows.append((i, " ".join(body[:at] + line + body[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring_dedup.removed_words(docs).collect())) == brute_removed(rows)


def test_substrings_empty_repeated_and_null_ids(spark, nothing):
    assert substring_dedup.removed_words(nothing).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.removed_words(docs).collect())
    assert got == [("5", 0), ("5", 0), ("7", 70), ("None", 0)]


def test_substrings_of_different_texts_with_one_id(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    shared, other = ([r.choice(words) for _ in range(90)] for _ in range(2))
    short, tail = ([r.choice(words) for _ in range(n)] for n in (20, 70))
    texts = [(0, shared), (1, shared), (1, short), (1, tail + shared), (1, other), (2, other + tail), (2, short), (2, shared[:60] + tail), (2, shared[:60] + tail), (0, tail)]
    rows = [(i, " ".join(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring_dedup.removed_words(docs).collect())) == brute_removed(rows)


# -- lines ---------------------------------------------------------------------


def test_lines_of_a_template(spark):
    rows = [(i, f"Copyright 20{i:02d} by user number {i} of it\nown text of document {i * 7919} {'abcdefghijkl'[i]} only") for i in range(5)]
    rows += [(10, "plain text\n\nplain text"), (11, None), (12, ""), (13, "plain text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, masked string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.without_recurring(docs).collect()}
    assert got[0][1] >= 1 and "Copyright" not in got[0][2]
    assert got[10] == (3, 0, "plain text\n\nplain text")
    assert got[11] == (1, 0, "") and got[12] == (1, 0, "")


def test_lines_on_hard_rows(hard, nothing):
    docs, rows = hard
    assert line_dedup.without_recurring(nothing).count() == 0
    got = line_dedup.without_recurring(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r.n_lines == len(texts[r.doc_id].split("\n"))
        kept = r.kept_text.split("\n") if r.n_lines > r.n_dropped else []
        assert len(kept) == r.n_lines - r.n_dropped
    log = next(r for r in got if texts[r.doc_id].startswith("a line 1 of"))
    assert log.n_dropped == 6


def brute_lines(rows, depth=3, fields=30, min_docs=3):
    """Dropped (row, line) by writing out every template of every line."""
    members, of = {}, {}
    for at, (doc, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line)]
            n = len(tokens)
            if not n:
                continue
            most = n * fields // 100
            width = max(1, most // 2)
            stretches = range(depth, n, width)
            for k in range(min(most, 2) + 1):
                for chosen in itertools.combinations(stretches, k):
                    gone = {i for c in chosen for i in range(c, min(c + width, n))}
                    template = tuple(None if i in gone else x for i, x in enumerate(tokens))
                    members.setdefault(template, set()).add(doc)
                    of.setdefault((at, pos), []).append(template)
    return {place for place, found in of.items() if any(len(members[t]) >= min_docs for t in found)}


def check_lines(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = brute_lines(rows)
    want = []
    for at, (doc, text) in enumerate(rows):
        parts = (text or "").split("\n")
        kept = [x for pos, x in enumerate(parts) if (at, pos) not in gone]
        want.append((str(doc), len(parts), len(parts) - len(kept), "\n".join(kept)))
    got = [(str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.without_recurring(docs).collect()]
    assert sorted(got) == sorted(want)
    return gone


NAMES = "ann bob cid dan eve fay gus hal ida joe".split()


def test_two_templates_in_a_leaf(spark):
    first = [(i, f"this is a note from {x} about the weekly build report") for i, x in enumerate(NAMES)]
    second = [(20 + i, f"this is a page that {x} wrote on last monday evening") for i, x in enumerate(NAMES)]
    assert len(check_lines(spark, first)) == 10
    assert len(check_lines(spark, first + second)) == 20


def test_template_under_a_third_of_a_leaf(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    rows = [(i, f"this is a note from {x} about the weekly build {r.choice(words)}") for i, x in enumerate(NAMES)]
    rows += [(100 + i, "own\nthis is a " + " ".join(r.choice(words) for _ in range(8))) for i in range(60)]
    gone = check_lines(spark, rows)
    assert {(i, 0) for i in range(10)} <= gone
    assert {(10 + i, 0) for i in range(60)} <= gone and len(gone) < 80  # "own" goes, lines that only begin alike stay


def test_lines_of_every_length(spark):
    r = random.Random(4)
    rows = []
    for i in range(40):
        out = []
        for n in range(1, 30):
            line = [f"w{'abcdefghij'[j % 10]}" for j in range(n)]
            for _ in range(r.randint(0, 4)):
                line[r.randrange(n)] = r.choice(NAMES)
            out.append(r.choice([" ", "\t", "  "]).join(line))
        rows.append((None if i == 7 else i // 2, "\n".join(out)))
    assert 0 < len(check_lines(spark, rows)) < 40 * 29
    check_lines(spark, [*rows, (None, None), (90, "")])


def test_very_long_lines(spark):
    line = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(8000)]
    rows = [(i, " ".join([*line[: 5000 + i], x, *line[5001 + i :]])) for i, x in enumerate(NAMES[:4])]
    assert len(check_lines(spark, rows)) == 4


def test_no_python_in_native_plan(spark):
    plan = line_dedup.op7_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
