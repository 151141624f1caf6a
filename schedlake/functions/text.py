"""Text cleaning, notes, labels and search normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Unicode white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only the ASCII blank."""
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Trimmed text, with blank as NULL."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def address(*parts: Column) -> Column:
    """Concatenation that is NULL as soon as one part is NULL."""
    return F.concat(*parts)


def join_notes(*parts: Column, sep: str = "、") -> Column:
    """Non-null parts in the given order, joined; NULL when there is none. A part may be a string or an array of them."""
    return F.nullif(F.array_join(F.concat(*parts), sep), F.lit(""))


def note(when: Column, text: Column) -> Column:
    """One optional note as an array, ready for ``join_notes``."""
    return F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))


def map_terms(df: DataFrame, column: str, terms: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the term's other form from the dictionary (term, form), or the term itself."""
    forms = terms.select(F.col("term").alias("__term"), F.col("form").alias("__form"))
    return df.join(forms, F.col(column) == F.col("__term"), "left").withColumn(name, F.coalesce("__form", column)).drop("__term", "__form")


def map_value(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Small fixed dictionary as a CASE chain, so it folds into the scan's projection."""
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """NFKC. Spark has no built-in for it; pure-ASCII values travel to Python as NULL, so they cost next to nothing."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(_nfkc(F.when(~ascii_only, c)), c)


def search_text(c: Column, unicode: bool = True) -> Column:
    """Search form: NFKC, lower case, 臺 written as 台, no white space, punctuation or symbols."""
    folded = nfkc(c) if unicode else c
    return F.regexp_replace(F.translate(F.lower(folded), "臺", "台"), r"(?U)[\s\p{P}\p{S}]", "")


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def event_text_escape(c: Column) -> Column:
    """Escaping for calendar-event text values."""
    for raw, safe in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def path_url(base: str, *parts: Column) -> Column:
    """``base/part/part/`` with a trailing slash."""
    return F.concat(F.concat_ws("/", F.lit(base.rstrip("/")), *parts), F.lit("/"))


def rolling_hash(c: Column) -> Column:
    """h = h * 31 + code, modulo 2^32, over the characters."""
    codes = F.transform(F.split(c, ""), F.ascii)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(4294967296)))


def variant(seed: Column, n: int, offset: int = 0) -> Column:
    """Stable variant index in 0..n-1 for a hash value."""
    return F.pmod(seed + offset, F.lit(n)).cast("int")


def content_id(key: Column, length: int = 10) -> Column:
    """First hex digits of SHA-256, upper case."""
    return F.upper(F.substring(F.sha2(key, 256), 1, length))
