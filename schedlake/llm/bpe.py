"""Operator 10: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (token bytes and rank per line) becomes a BPE model over the byte alphabet: every byte is written as one
printable character, tokens are strings over that alphabet, and a merge exists for every split of a token into two tokens,
ordered by the token's rank. Texts are cut at single blanks between two visible characters. The split pattern never
matches across such a place, so the pieces are independent; a bounded table per task keeps the ids of pieces already seen.

Nulls count as the empty text (no ids). Empty texts give an empty list. Very long texts are handled alone, whole. Extra
columns are ignored: the operators read the id and the text (or ids) column only.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from schedlake.llm.common import documents, text_slices

#: Pieces whose ids a task keeps; beyond it the table starts anew.
KEPT_PIECES = 300_000
CUT = re.compile(r"(?<=\S) (?=\S)").split


def byte_alphabet() -> list[str]:
    """The printable character for each byte: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        letters = byte_alphabet()
        written = {token: "".join(map(letters.__getitem__, token)) for token in by_bytes}
        merges = [
            (written[token[:i]], written[token[i:]])
            for token in sorted(by_bytes, key=by_bytes.get)
            for i in sorted(range(1, len(token)), key=lambda i: max(by_bytes.get(token[:i], 1 << 60), by_bytes.get(token[i:], 1 << 60)))
            if token[:i] in by_bytes and token[i:] in by_bytes
        ]
        self.model = Tokenizer(models.BPE(vocab={written[t]: r for t, r in by_bytes.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        #: The byte table reversed: token bytes by id, read back from the model's own strings.
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [b""] * (max(by_bytes.values()) + 1)
        for text, rank in self.model.get_vocab().items():
            self.token_bytes[rank] = bytes(map(back.__getitem__, text))
        self.seen: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [CUT(t) if t else [] for t in texts]
        cut = [[c[0], *(" " + piece for piece in c[1:])] if c else c for c in cut]
        if len(self.seen) > KEPT_PIECES:
            self.seen = {}
        seen = self.seen
        fresh = [p for p in {p for c in cut for p in c} if p not in seen]
        for piece, found in zip(fresh, self.model.encode_batch_fast(fresh, add_special_tokens=False)):
            seen[piece] = found.ids
        return [[i for p in c for i in seen[p]] for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def starts(self, ids: list[int]) -> list[int]:
        """Character in which each token starts; tokens inside a character get that character."""
        ends = list(accumulate((len(self.token_bytes[i]) for i in ids), initial=0))
        opened = np.concatenate([[0], np.cumsum((np.frombuffer(self.decode(ids), np.uint8) & 0xC0) != 0x80)])
        return [int(opened[b + 1]) - 1 if b + 1 < len(opened) else int(opened[-1]) for b in ends[:-1]]


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return Codec(ranks, pattern)


def _ranks(spark: SparkSession, rank_file: str):
    """The rank file as a broadcast: one fixed vocabulary file, about 1 MB whatever the size of the corpus."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, starts array<int>): token ids of each whole text and the character each token starts in."""
    held = _ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for part in text_slices(batches, text_col):
            ids = c.encode([t or "" for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(ids, pa.list_(pa.int32())), pa.array([c.starts(x) for x in ids], pa.list_(pa.int32()))], [id_col, "ids", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary, text string): bytes of the ids; in ``text`` a character whose bytes are not all there becomes U+FFFD.

    A null or unknown id raises; a null list gives empty bytes.
    """
    held = _ranks(tokens.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [c.decode(x or []) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())], [id_col, "bytes", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary, text string")


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode each whole text, decode its ids, and keep digests of both.

    The ids never leave the task, so nothing but the digests is written or shuffled.
    """
    held = _ranks(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        decimal = [str(i) for i in range(len(c.token_bytes))]
        for part in text_slices(batches, text_col):
            ids = c.encode([t or "" for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id_col),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
