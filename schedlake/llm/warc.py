"""Operator 11: WARC archives with segmented records, read back by segment reassembly.

Writing: every row becomes a record. Payloads are framed as chunked transfer coding inside an HTTP response; of rows with equal
payloads of a given size the first by id is stored and the others become revisit records that refer to it. A block longer than
a segment is cut: the first segment keeps the record's type, the others are continuation records with the origin's
identifier and their number, the last one states the total length. Spark's text writer puts the records into gzip files on any
file system it can reach: its line separator is the record's end.

Reading: Spark's text reader cuts the files at the version line. A payload may contain that line; a record shorter than its
Content-Length is completed with what follows in the same file. Whole records are decoded where they are read. Segments are
grouped by their origin identifier, ordered by number, checked for gaps and against the total length, joined, and then
decoded like the others. Every payload is checked against its digest. Revisits take length and id from the record that they refer to.

Null payloads count as empty. Null ids sort after all others and are read back as null; rows that repeat an id, or are fully
equal, are records of their own, one of which is the response. A null url gives a record without target; characters that a header
can't hold are percent-encoded. A very long payload is one row, as it is in the input; its segments meet in one group of its size. An empty table gives an empty
archive, which reads back as no rows. Only the three named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import settle, text_bytes, text_slices
from schedlake.session import work_dir

#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Bytes of a block that one record holds, bytes of one chunk of its payload, records per file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32 << 10, 8 << 10, 200_000
#: Longest header that a reader puts together.
HEADER_BYTES = 1 << 20
#: Smallest payload that a revisit may stand for.
REVISIT_BYTES = 100
#: Parts that the rows of one payload are split into when they meet the row stored for it.
SALTS = 16


def record_id(archive: str, row: int, segment: int = 1) -> str:
    """Identifier of a record: the same for a task that runs again."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive}/{row}/{segment}'.encode()).digest()[:16], version=4)}>"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer coding: hexadecimal length, bytes, and an empty chunk at the end."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped. Raises where a chunk is cut short."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";", 1)[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response: what follows its header, decoded where the header says chunked."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header without its end")
    fields = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coded = any(name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower() for name, _, value in fields)
    return dechunked(body) if coded else body


def _header(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    return (VERSION + "\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def records(archive: str, row: int, key: str | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one row without their end: a revisit where ``first`` names another row, else a response in one or more segments."""
    own = record_id(archive, row)
    common = [
        ("WARC-Record-ID", own), ("WARC-Date", date), ("X-Row-Id", None if key is None else urllib.parse.quote(key, safe="")),
        ("WARC-Target-URI", None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if first is not None:
        revisit = [("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(archive, first))]
        yield _header(revisit, len(HTTP_HEAD)) + HTTP_HEAD
        return
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _header([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1" if len(parts) > 1 else None)], len(parts[0])) + parts[0]
    for number, part in enumerate(parts[1:], 2):
        total = str(len(block)) if number == len(parts) else None
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(archive, row, number)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number)), ("WARC-Segment-Total-Length", total)]
        yield _header(more, len(part)) + part


def _salted(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str) -> DataFrame:
    """Join many rows with the one row of their key, the rows of a key spread over SALTS parts."""
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [key, "__salt"], how).drop("__salt")


def write_archive(
    rows: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: str = "2026-01-01T00:00:00Z",
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS,
) -> None:
    """Write ``rows`` as gzip WARC files below ``path``, a folder that must not exist."""
    numbered = settle(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    light = settle(numbered.filter(F.octet_length("payload") >= revisit_bytes).select("row", "key", digest.alias("digest")))
    first = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row"))
    stored = light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1").select("digest", F.col("first.row").alias("first"))
    revisits = settle(_salted(light.select("row", "digest"), stored, "digest", F.col("row"), "inner").filter("row <> first").select("row", "first"))
    archive = path.rstrip("/").rsplit("/", 1)[-1]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "payload"):
            light = part.select(["row", "key", "url", "digest", "first"]).to_pylist()
            made = [
                record for r, payload in zip(light, text_bytes(part, "payload"))
                for record in records(archive, r["row"], r["key"], r["url"], payload, r["digest"], r["first"], date, segment_bytes, chunk_bytes)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    planned = numbered.join(revisits, "row", "left").select("row", F.col("key").cast("string").alias("key"), "url", "payload", digest.alias("digest"), "first")
    lines = planned.mapInArrow(build, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a record's header, names in lower case."""
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}


def split_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record from (file, piece) in file order, pieces being what lies between two version lines.

    A header or block that holds the version line itself is put together again from the pieces of its file.
    """
    mark = VERSION.encode()
    file, fields, held, got = None, None, [], 0
    for name, piece in pieces:
        if name != file:
            if held:
                raise ValueError(f"{file} ends inside a record")
            if piece:
                raise ValueError(f"{name} does not begin with a record")
            file = name
            continue
        held.append(mark + piece if held else piece)
        got += len(held[-1])
        if fields is None:
            head, found, rest = b"".join(held).partition(b"\r\n\r\n")
            if not found:
                if got > HEADER_BYTES:
                    raise ValueError(f"{file} holds a header without its end")
                continue
            fields, held, got = header_fields(head), [rest], len(rest)
        need = int(fields["content-length"])
        if got >= need:
            yield fields, b"".join(held)[:need]
            fields, held, got = None, [], 0
    if held:
        raise ValueError(f"{file} ends inside a record")


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (pair for batch in batches for pair in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()))
        out, size = [], 0
        for fields, block in split_records(pieces):
            out.append(_row(fields, block, payloads))
            size += len(block)
            if size > 4 << 20 or len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, RAW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, RAW)

    return run


RAW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("row_id", pa.string()), ("digest", pa.string()), ("refers", pa.string()),
    ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
])
RAW_DDL = "record_id string, record_type string, url string, row_id string, digest string, refers string, origin string, segment bigint, total bigint, block binary, payload binary, payload_bytes bigint"


def _checked(block: bytes, digest: str | None) -> bytes:
    payload = payload_of(block)
    if digest is not None and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        raise ValueError("payload differs from its digest")
    return payload


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    """A record; whole responses are decoded at once, segments keep their block."""
    row = {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"),
        "row_id": urllib.parse.unquote(fields["x-row-id"]) if "x-row-id" in fields else None,
        "digest": fields.get("warc-payload-digest"), "refers": fields.get("warc-refers-to"),
        "segment": int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None,
        "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
    }
    row["origin"] = fields.get("warc-segment-origin-id", row["record_id"] if row["segment"] else None)
    if row["segment"]:
        row["block"] = block
    elif row["record_type"] == "response":
        payload = _checked(block, row["digest"])
        row["payload_bytes"] = len(payload)
        if payloads:
            row["payload"] = payload
    return row


def reassembled(segments: DataFrame) -> DataFrame:
    """Records from their segments: (record_id, record_type, url, row_id, digest, payload, payload_bytes).

    Stops on a missing or repeated segment and on a length other than the stated total.
    """
    part = F.struct("segment", "block", "total")
    first = F.first(F.when(F.col("segment") == 1, F.struct("record_type", "url", "row_id", "digest")), ignorenulls=True)
    whole = segments.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"), first.alias("head"))
    joined = F.concat_ws("", F.col("parts.block").cast("array<string>")).cast("binary")
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts").cast("long"))
    wrong = ~gapless | F.col("head").isNull() | ~F.octet_length("block").cast("long").eqNullSafe(F.element_at("parts", -1)["total"])
    checked = whole.withColumn("block", joined).withColumn("block", F.when(wrong, F.raise_error(F.concat(F.lit("segments do not make up "), "origin"))).otherwise(F.col("block")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in text_slices(batches, "block"):
            found = [_checked(b, d) for b, d in zip(text_bytes(slice_, "block"), slice_.column("digest").to_pylist())]
            names = ["record_id", "record_type", "url", "row_id", "digest"]
            yield pa.RecordBatch.from_arrays([*(slice_.column(n) for n in names), pa.array(found, pa.binary()), pa.array(map(len, found), pa.int64())], [*names, "payload", "payload_bytes"])

    return checked.select(F.col("origin").alias("record_id"), "head.*", "block").mapInArrow(
        decode, "record_id string, record_type string, url string, row_id string, digest string, payload binary, payload_bytes bigint")


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, url, row_id, payload_digest, payload_bytes, refers_to_record, refers_to, and payload if asked for).

    ``refers_to`` is the row id of the record that a revisit refers to; its payload length is that record's (its payload is not copied).
    ``path``: a folder of .gz archives, or of archives that are read in one piece.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    read = settle(pieces.mapInArrow(_read(payloads), RAW_DDL))
    names = ["record_id", "record_type", "url", "row_id", "digest", "payload", "payload_bytes"]
    joined = reassembled(read.filter("segment is not null").select("origin", "segment", "block", "total", "record_type", "url", "row_id", "digest"))
    if not payloads:
        joined = joined.withColumn("payload", F.lit(None).cast("binary"))
    stored = read.filter("segment is null and record_type = 'response'").select(*names).unionByName(settle(joined))
    asked = read.filter("record_type = 'revisit'").select("record_id", "record_type", "url", "row_id", "digest", F.col("refers").alias("target"))
    wanted = stored.select(F.col("record_id").alias("target"), "row_id", "payload_bytes").join(asked.select("target").distinct(), "target", "left_semi")
    resolved = _salted(asked, wanted.withColumnRenamed("row_id", "refers_to"), "target", F.col("record_id"), "left")
    resolved = resolved.withColumn("payload", F.lit(None).cast("binary")).withColumn("refers_to_record", F.col("target"))
    told = stored.withColumn("refers_to", F.lit(None).cast("string")).withColumn("refers_to_record", F.lit(None).cast("string"))
    keep = ["record_id", "record_type", "url", "row_id", F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"), "payload_bytes", "refers_to_record", "refers_to"]
    return told.select(*keep, *(["payload"] if payloads else [])).unionByName(resolved.select(*keep, *(["payload"] if payloads else [])))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    write_archive(pages, path, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    read = read_archive(spark, path, payloads=False)
    return read.select(F.col("row_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP11_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages
), t AS (
  SELECT page_id, octet_length(raw) AS payload_bytes, sha256(raw) AS payload_digest, min(page_id) OVER (PARTITION BY raw) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM t
"""
