"""Fixtures of the training-data operators: hard rows in a small documents table."""

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside must not clash
    T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()), T.StructField("__id", T.StringType()),
])


def vocabulary(seed: int, letters: str, n: int = 300) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n)]


def hard_rows() -> list[tuple]:
    """Nulls, empties, repeats, ties, case variants, shared passages, odd blanks and a very long text."""
    r = random.Random(5)
    words = vocabulary(1, "abcdefghij")
    passage = " ".join(r.choice(words) for _ in range(80))
    texts: list[str | None] = [None, "", " \t\n", "one", "Two words", "two WORDS", "three little words", "ÀÉ À é", "àé à é"]
    texts += [passage, passage, passage.upper(), passage.replace(" ", "\n", 7), passage + " tail", "head " + passage]
    for _ in range(25):
        own = " ".join(r.choice(words) for _ in range(r.randint(1, 200)))
        texts += [own, own[: len(own) // 2] + " " + passage + "\n" + own[len(own) // 2 :]]
    texts += ["x " * 130, "x " * 60, "\n".join(["a line 1 of log", "a line 22 of log"] * 3), "a line 3 of log\nother", "a line 4 of log\nmore"]
    texts += [" ".join(r.choice(words) for _ in range(30_000)), "w" * 70_000, "a b c​d\x1ce 日本語 한국어 🙂🙂  12 ½ it's we'LL"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 % 101, t, ["en", "de", None][i % 3], ["s1", "s2", None, "S3"][i % 4], None if t is None else len(t), "x", "y", "z"))
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    rows = hard_rows()
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
