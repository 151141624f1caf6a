"""WARC archives, Merkle manifest and fill-in-middle against plain Python."""

import glob
import gzip
import hashlib
import random
import re
import uuid
import zlib

import pytest
from llm_rows import hard, nothing  # noqa: F401
from pyspark.sql import functions as F

from schedlake.llm import fill_in_middle, merkle, warc
from schedlake.llm.queries import CHECKS, QUERIES
from schedlake.session import work_dir
from tools.parity import duck, rows_of

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_warc", "op12_merkle_manifest", "op13_fill_in_middle"])
def test_sql_parity(spark, name):
    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(CHECKS[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


# -- fill-in-middle --------------------------------------------------------------


def brute_fim(key, text, seed=42):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"{seed}:{key}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_hard_rows(spark, hard, nothing):
    docs, rows = hard
    extra = [(500 + i, t) for i in range(8) for t in ("<", "a <P b", "a <P> b", "S> <S", "é <M>", " x ", "< P>", "b <S")] + [(None, "no id"), (7, "seven"), (7, "seven again")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    assert fill_in_middle.digests(nothing).count() == 0
    want = sorted((i if i is not None else -1, *brute_fim("" if i is None else i, t)) for i, t in [(r[0], r[1]) for r in rows] + extra)
    outputs = fill_in_middle.transformed(both)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in outputs.collect())
    assert got == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = sorted((r.doc_id or -1, r.text) for r in fill_in_middle.restored_texts(outputs).collect())
    assert back == sorted((i or -1, t or "") for i, t in [(r[0], r[1]) for r in rows] + extra)
    hashed = sorted((r.doc_id if r.doc_id is not None else -1, r.output_sha256) for r in fill_in_middle.digests(both).collect())
    assert hashed == sorted((w[0], sha(w[-1])) for w in want)


def test_piece_table_cuts_and_inverse():
    r = random.Random(3)
    for _ in range(300):
        raw = "".join(r.choice("ab é\n<") for _ in range(r.randint(1, 30))).encode()
        ends = [0, *fill_in_middle.token_ends(raw).tolist()]
        places = sorted((r.choice(ends), r.choice(ends)))
        parts = fill_in_middle.Pieces((raw,), ((0, 0, len(raw)),)).cut(*places)
        assert [bytes(v) for v in parts.stream()] == [raw[: places[0]], raw[places[0] : places[1]], raw[places[1] :]]
        for form in fill_in_middle.FORMS:
            assert fill_in_middle.restored(fill_in_middle.arranged(parts, form).render(), form).render() == raw


# -- Merkle manifest -------------------------------------------------------------


def brute_tree(hashes):
    """Root and the (before, after) siblings of each leaf."""
    nodes = [(h, [i]) for i, h in enumerate(hashes)]
    paths = [[] for _ in hashes]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 2):
            pair = nodes[at : at + 2]
            for k, (_, below) in enumerate(pair):
                for i in below:
                    paths[i].append(("".join(h for h, _ in pair[:k]), "".join(h for h, _ in pair[k + 1 :])))
            up.append((sha("".join(h for h, _ in pair)), [i for _, below in pair for i in below]))
        nodes = up
    return nodes[0][0], paths


def brute_manifest(rows):
    """rows: (lang, doc_id, leaf). Sorted (lang, doc_id, leaf, path, subroot, root)."""
    def first(x):
        return (x is not None, x)

    groups = {}
    for lang, i, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), first(r[1])[0], r[1] or 0, r[2])):
        groups.setdefault(lang, []).append((i, leaf))
    below = {g: brute_tree([leaf for _, leaf in rows]) for g, rows in groups.items()}
    root, above = brute_tree([sub for sub, _ in below.values()])
    return [
        (g, i, leaf, [*below[g][1][at], *above[k]], below[g][0], root)
        for k, (g, rows) in enumerate(groups.items()) for at, (i, leaf) in enumerate(rows)
    ]


@pytest.mark.parametrize("sizes", [{None: 700, "en": 300, "dé": 257, "z": 256, "日": 1, "a": 3}, {"only": 1}, {"en": 5}, {f"g{i}": 1 for i in range(300)}])
def test_merkle_against_brute_force(spark, sizes):
    r = random.Random(1)
    rows = []
    for lang, n in sizes.items():
        ids = [r.randint(-(10**12), 10**12) for _ in range(n)]
        if n > 100:
            ids[:3] = [None, None, ids[5]]  # null and repeated ids
        rows += [(lang, i, sha(f"{lang} {i} {k % 90}")) for k, i in enumerate(ids)]
    rows += rows[:2]  # fully equal rows
    df = spark.createDataFrame(rows, "lang string, doc_id long, hash string").repartition(3)
    leaves = df.select(merkle.group_key(F.col("lang")).alias("grp"), "hash", "doc_id", F.struct("doc_id", "lang").alias("item"))
    proofs = merkle.manifest(leaves, ["doc_id"]).withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path")))
    got = proofs.collect()
    assert all(g.back == g.root for g in got)
    want = brute_manifest(rows)
    order = lambda x: (str(x[0]), str(x[1]), x[2], str(x[3]))
    assert sorted([(g["item"].lang, g["item"].doc_id, g.leaf, [tuple(s) for s in g.path], g.subroot, g.root) for g in got], key=order) == sorted(want, key=order)
    by_leaf = sorted((w[2], sha("".join(b + a for b, a in w[3]))) for w in want)
    assert sorted((g.leaf, g.proof) for g in got) == by_leaf


def test_merkle_ranks_do_not_hang_on_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rows = [("en", i * 37 % 400, sha(str(i))) for i in range(400)] + [("fr", 5, sha("x"))] * 200
    leaves = spark.createDataFrame(rows, "grp string, doc_id long, hash string").withColumn("item", F.struct("doc_id"))
    nodes, most = merkle.ranked(leaves, ["doc_id", "hash"])
    assert most == 400
    got = nodes.collect()
    assert sorted(g["rank"] for g in got if g.grp == "fr") == list(range(200))
    assert all(g["rank"] == g.doc_id for g in got if g.grp == "en")
    assert {(g.grp, g.height) for g in got} == {("en", 9), ("fr", 8)}


def test_merkle_hard_rows(spark, hard, nothing, tmp_path):
    docs, rows = hard
    nothing.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, f"{tmp_path}/empty").count() == 0
    docs.write.parquet(f"{tmp_path}/hard/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, f"{tmp_path}/hard").collect()

    def leaf(r, more=0):
        values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    want = []
    by_id = {}
    for r in rows:
        by_id.setdefault((r[0], leaf(r)), r)
    for lang, i, own, path, sub, root in brute_manifest([(r[2], r[0], leaf(r)) for r in rows]):
        node = leaf(by_id[i, own], 1) if zlib.crc32(str(i).encode()) % 7 == 0 else own
        for before, after in path:
            node = sha(before + node + after)
        want.append((i, own, sub, root, sha("".join(b + a for b, a in path)), node, node == root))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[-1] for w in want} == {True, False}


# -- WARC ------------------------------------------------------------------------


def page_rows():
    r = random.Random(9)
    hot = "<p>" + "same body " * 30
    rows = [(i, f"http://h/{i}", hot) for i in (9, 4, 4, 200, 77)] + [(None, "http://n", hot), (None, None, "x" * 150), (None, "u", "x" * 150)]
    rows += [(300 + i, "http://short/é x\r\ny", "tiny") for i in range(4)] + [(310, None, None), (311, "", ""), (312, "http://WARC/1.1", "ends WARC/1.1\r\n")]
    rows += [(320, "v", "a WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (321, "v", "\r\n\r\nWARC/1.1\r\n" * 2000), (322, "w", "ü日🙂" * 20_000), (323, "w", "ü日🙂" * 20_000)]
    rows += [(330, "99", "y" * 99), (331, "99", "y" * 99), (332, "100", "z" * 100), (333, "100", "z" * 100), (334, "é", "é" * 50), (335, "é", "é" * 50)]
    rows += [(1000 + i, f"http://h/{i}", "".join(r.choice("abc \n") for _ in range(r.randint(0, 5000)))) for i in range(60)]
    rows += [(77, "http://h/77", hot)]
    return [(*r, "clash", "clash") for r in rows]


def brute_pages(rows):
    raw = [(i, (h or "").encode()) for i, _, h, _, _ in rows]
    first = {}
    for i, b in raw:
        if len(b) >= 100:
            first.setdefault(b, []).append((i is None, i or 0))
    want = []
    for b in {b for _, b in raw}:
        members = [(i is None, i or 0, i) for i, x in raw if x == b]
        members.sort()
        for k, (_, _, i) in enumerate(members):
            revisit = len(b) >= 100 and k > 0
            want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", members[0][2] if revisit else None))
    return want


def key(r):
    return tuple((v is None, str(v)) for v in r)


@pytest.mark.parametrize("segment,chunk", [(32 << 10, 8 << 10), (700, 64), (100_000_000, 1)])
def test_warc_round_trip(spark, segment, chunk):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, payload string").repartition(4)
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_archive(pages, path, "page_id", "url", "html", segment_bytes=segment, chunk_bytes=chunk)
    got = warc.read_archive(spark, path).collect()
    assert len({g.record_id for g in got}) == len(rows)
    seen = [(None if g.row_id is None else int(g.row_id), g.payload_bytes, g.payload_digest, g.record_type, None if g.refers_to is None else int(g.refers_to)) for g in got]
    assert sorted(seen, key=key) == sorted(brute_pages(rows), key=key)
    payloads = {hashlib.sha256((r[2] or "").encode()).hexdigest(): (r[2] or "").encode() for r in rows}
    assert all(bytes(g.payload) == payloads[g.payload_digest] for g in got if g.record_type == "response")
    types = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert types.startswith(b"WARC/1.1\r\nWARC-Type: ") and types.endswith(b"\r\n\r\n")
    assert (b"WARC-Type: continuation" in types) == (segment < 100_000_000)


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    warc.write_archive(pages, path, "page_id", "url", "html")
    assert warc.read_archive(spark, path).count() == 0


def archive(folder, records):
    folder.mkdir()
    with gzip.open(folder / "one.warc.gz", "wb") as f:
        for fields, block in records:
            told = {"Content-Length": len(block), **fields}
            f.write(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told.items()) + "\r\n").encode() + block + b"\r\n\r\n")
    return str(folder)


def test_warc_of_others(spark, tmp_path):
    """Records out of order, chunk extensions, plain bodies and other record types."""
    block = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n5;name=x\r\nhello\r\nA\r\n wide worl\r\n1\r\nd\r\n0\r\nTrailer: y\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nplain\r\n\r\nbody"
    info = ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x\r\n")
    first = ({"warc-type": "response", "WARC-Record-ID": "<a>", "WARC-Segment-Number": "1"}, block[:50])
    second = ({"WARC-Type": "continuation", "WARC-Record-ID": "<a2>", "WARC-Segment-Origin-ID": "<a>", "WARC-Segment-Number": "2"}, block[50:60])
    third = ({"WARC-Type": "continuation", "WARC-Record-ID": "<a3>", "WARC-Segment-Origin-ID": "<a>", "WARC-Segment-Number": "3", "WARC-Segment-Total-Length": str(len(block))}, block[60:])
    other = ({"WARC-Type": "response", "WARC-Record-ID": "<b>", "WARC-Target-URI": "http://b"}, plain)
    got = warc.read_archive(spark, archive(tmp_path / "good", [info, third, other, first, second])).collect()
    assert sorted((g.record_id, bytes(g.payload)) for g in got) == [("<a>", b"hello wide world"), ("<b>", b"plain\r\n\r\nbody")]
    wrong = ({**third[0], "WARC-Segment-Total-Length": "7"}, third[1])
    for name, records in {"gap": [first, third], "length": [first, second, wrong], "twice": [first, second, second, third], "headless": [second, third], "open": [first, second]}.items():
        with pytest.raises(Exception, match="segments do not make up"):
            warc.read_archive(spark, archive(tmp_path / name, records)).collect()
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, archive(tmp_path / "digest", [({**other[0], "WARC-Payload-Digest": "sha256:00"}, plain)])).collect()
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archive(spark, archive(tmp_path / "cut", [({**other[0], "Content-Length": "9999"}, b"")])).collect()
