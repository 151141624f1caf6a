"""Operator 13: fill-in-middle transformation with piece tables.

A document becomes descriptors (buffer, start, length) over two immutable buffers, its text and the sentinels. Cutting splits
the descriptor of the text, an arrangement permutes the parts and puts sentinel descriptors between them, the inverse
permutation restores the order, and digests read the descriptors one after the other, so no rearranged copy is made for them.

A token is a word with the blanks before it; blanks at the end are one token. Blanks are six ASCII characters, so texts are
cut as UTF-8 bytes and no character is ever split. Cuts, form and order hang on a hash of seed and id alone, so reruns and
other partitions agree. Documents are transformed one by one; nothing is shuffled.

Null texts count as empty; empty texts, and texts that contain a sentinel, stay plain. A null id draws like the empty string;
rows that repeat an id draw alike, each on its own text. Texts of blanks are one token. Very long texts are handled alone,
whole. Only the id and the text column are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from schedlake.llm.common import documents, text_bytes, text_slices

#: The sentinels before prefix, suffix and middle, and the order of the parts in each form.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
READING = ("prefix", "middle", "suffix")
#: Per cent of the documents that are cut, and per cent of those in the form spm.
CUT_SHARE, SPM_SHARE = 50, 80

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Pieces:
    """Descriptors (buffer number, start, length) over immutable buffers."""

    buffers: tuple[bytes, ...]
    spans: tuple[tuple[int, int, int], ...]

    def cut(self, *places: int) -> Pieces:
        """Split descriptors so that one ends at each of ``places`` (ascending byte offsets); a place met twice gives an empty piece."""
        out, done, left = [], 0, list(places)
        for buffer, start, length in self.spans:
            while left and left[0] <= done + length:
                head = left.pop(0) - done
                out.append((buffer, start, head))
                start, length, done = start + head, length - head, done + head
            out.append((buffer, start, length))
            done += length
        return Pieces(self.buffers, tuple(out))

    def permuted(self, order: Iterable[int]) -> Pieces:
        return Pieces(self.buffers, tuple(self.spans[i] for i in order))

    def stream(self) -> Iterator[memoryview]:
        views = [memoryview(b) for b in self.buffers]
        return (views[buffer][start : start + length] for buffer, start, length in self.spans)

    def digest(self) -> str:
        sha = hashlib.sha256()
        for view in self.stream():
            sha.update(view)
        return sha.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.stream())


def arranged(parts: Pieces, form: str) -> Pieces:
    """Prefix, middle and suffix of one text in the order of ``form``, a sentinel descriptor before each."""
    marks = b"".join(SENTINELS[name] for name in READING)
    moved = parts.permuted(READING.index(name) for name in FORMS[form])
    spans = [span for name, part in zip(FORMS[form], moved.spans) for span in ((1, marks.index(SENTINELS[name]), len(SENTINELS[name])), part)]
    return Pieces((parts.buffers[0], marks), tuple(spans))


def restored(output: bytes, form: str) -> Pieces:
    """The text in an output: descriptors over the output, sentinels left out, in reading order.

    A cut text holds no sentinel, and no sentinel ends as another begins, so each occurs once.
    """
    if form == "plain":
        return Pieces((output,), ((0, 0, len(output)),))
    order = FORMS[form]
    at = [output.index(SENTINELS[name]) for name in order]
    starts = [a + len(SENTINELS[name]) for a, name in zip(at, order)]
    parts = Pieces((output,), tuple((0, s, e - s) for s, e in zip(starts, [*at[1:], len(output)])))
    return parts.permuted(order.index(name) for name in READING)


def token_ends(raw: bytes) -> np.ndarray:
    """Byte offset after each token: where a word ends before a blank, and the end of the text."""
    if not raw:
        return np.zeros(0, np.int64)
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    return np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(raw))


def _chars(view: memoryview) -> int:
    """Code points: bytes that do not continue a character."""
    return int(np.count_nonzero((np.frombuffer(view, np.uint8) & 0xC0) != 0x80))


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: Pieces


def transform(key: str, raw: bytes, seed: int) -> Transformed:
    """One document: cut places, form and order from a hash of seed and ``key``."""
    drawn = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    first, second, whether, which = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = token_ends(raw)
    n = len(ends)
    text = Pieces((raw,), ((0, 0, len(raw)),))
    if not raw or whether % 100 >= CUT_SHARE or any(mark in raw for mark in SENTINELS.values()):
        return Transformed(n, "plain", None, None, text)
    places = [int(ends[k - 1]) if k else 0 for k in sorted((first % (n + 1), second % (n + 1)))]
    parts = text.cut(*places)
    prefix, middle, _ = parts.stream()
    form = "spm" if which % 100 < SPM_SHARE else "psm"
    return Transformed(n, form, _chars(prefix), _chars(middle), arranged(parts, form))


def _mapped(docs: DataFrame, columns: str, names: list[str], row, seed: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in schema]
        for part in text_slices(batches, text_col):
            keys = ["" if k is None else str(k) for k in part.column(id_col).to_pylist()]
            rows = [row(transform(key, raw, seed)) for key, raw in zip(keys, text_bytes(part, text_col))]
            made = [pa.array(values, kind) for values, kind in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *made], [id_col, *names])

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in zip(names, columns.split())])
    listed = ", ".join(f"{name} {kind}" for name, kind in zip(names, columns.split()))
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {listed}")


def transformed(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): the training text of each document."""
    def row(t: Transformed) -> tuple:
        return t.n, t.form, t.prefix_chars, t.middle_chars, t.pieces.render().decode()

    return _mapped(docs, "bigint string bigint bigint string", ["n", "form", "prefix_chars", "middle_chars", "output"], row, seed, id_col, text_col)


def restored_texts(outputs: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """(id, text): the exact text of each output of ``transformed``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, output_col):
            texts = [restored(raw, form).render().decode() for raw, form in zip(text_bytes(part, output_col), part.column(form_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    kind = outputs.schema[id_col].dataType.simpleString()
    return outputs.select(id_col, form_col, output_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): transform each text, restore the text from
    the output and its form, and digest both by streaming their descriptors."""
    def row(t: Transformed) -> tuple:
        return t.n, t.form, t.prefix_chars, t.middle_chars, t.pieces.digest(), restored(t.pieces.render(), t.form).digest()

    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return _mapped(docs, "bigint string bigint bigint string string", names, row, seed, id_col, text_col)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), d AS (
  SELECT doc_id, text, tokens, len(tokens) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(tokens) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), c AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS p, array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS s
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
