"""Operator 7: line dedup with a log-template tree, with DataFrame functions only.

Lines are parsed as log messages are, by a tree of fixed depth: first the number of tokens, then the leading ``DEPTH``
tokens, where tokens with a digit count as a field. Below, the other tokens are cut into stretches, each a level of the tree: a
node has a branch for every text of the next stretch and one branch for a field, and a path takes at most two field branches,
which together cover at most ``FIELDS`` percent of the line (``cuts``). A leaf is a template: tokens and up to two
stretches of variable fields. A line belongs to every template on whose path it lies, so lines of several templates share the upper
nodes without hiding each other. A template that occurs in ``MIN_DOCS`` or more documents is recurring, and every line that
belongs to a recurring template is dropped. More rows never make a dropped line stay.

Branches grow level by level, two stretches at a time, and only nodes that occur in enough documents grow on, which loses
nothing, as a template never occurs in more documents than the nodes above it. Only lines below such nodes move any text. A
different line is represented by ``MIN_DOCS`` of its documents at most, which decides the same as all of them would. Counts are partial
sums, so a very frequent line or node sends one row per task and document. Blank lines are kept and belong to no node. Null
texts count as empty (one blank line). Rows that repeat an id are one document for the counts; a null id is a document too. Only
id and text are read. A very long line has no more stretches than a short one (at most ten).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.llm.common import documents, settle

DEPTH, FIELDS, MIN_DOCS = 3, 30, 3
FIELD = "<*>"
#: Most stretches that ``cuts`` gives: 13 tokens, three of them fields, the ten after the lead in stretches of one.
STRETCHES = 10


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _name(*parts: Column) -> Column:
    """A 128-bit name of the values."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("x"), F.xxhash64(F.lit(2), *parts).alias("y"))


def lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, masked): lines that are not blank, with fields masked and blanks evened out.

    Both replacements run once over the whole text, below the generator; the first touches only blanks that are not
    single already, the second looks at the beginnings of tokens only.
    """
    even = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    masked = F.regexp_replace(even, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", FIELD)
    each = docs.select("key", "doc_id", F.posexplode(_split(masked)).alias("pos", "line"))
    return each.select("key", "doc_id", "pos", F.trim("line").alias("masked")).filter("masked <> ''")


def upper() -> list[Column]:
    """What the upper tree reads of ``masked``: the number of tokens (less one) and the lead."""
    return [F.length("masked") - F.length(F.replace("masked", F.lit(" "))), F.substring_index("masked", " ", DEPTH)]


def cuts(n: Column) -> tuple[Column, Column]:
    """(length of a stretch, most stretches that are fields) of a line of ``n`` tokens: two stretches, or one where only one
    token may be a field, cover at most ``FIELDS`` percent of it."""
    most = F.floor(n * FIELDS / 100).cast("int")
    return F.greatest(F.lit(1), F.floor(most / 2).cast("int")), F.least(most, F.lit(2))


def stretches(kinds: DataFrame) -> DataFrame:
    """Add parts (a hash of each stretch after the lead) and fields (how many may be fields) to (masked, ..)."""
    tokens = F.split("masked", " ", -1)
    width, fields = cuts(F.col("n"))
    number = F.ceil((F.col("n") - DEPTH) / width).cast("int")
    # the array around the tokens makes them a value of the lambda, split once a line
    parts = F.transform(F.array(tokens), lambda t: F.transform(
        F.sequence(F.lit(0), number - 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i * width + DEPTH + 1, width), " "))))[0]
    return kinds.withColumn("n", F.size(tokens)).withColumn("parts", F.when(F.col("n") > DEPTH, parts).otherwise(F.array().cast("array<bigint>"))).withColumn("fields", fields).drop("n")


def grown(nodes: DataFrame) -> DataFrame:
    """Children of (kind, parts, fields, docs, node) at the next stretch: its text, and a field where one is left."""
    more = F.size("parts") > 0
    as_text = F.struct(F.when(more, _name(F.lit("text"), "node", F.get("parts", F.lit(0)))).otherwise(F.col("node")).alias("node"), F.col("fields").alias("fields"))
    as_field = F.struct(_name(F.lit("field"), "node").alias("node"), (F.col("fields") - 1).alias("fields"))
    children = F.when(more & (F.col("fields") > 0), F.array(as_text, as_field)).otherwise(F.array(as_text))
    return nodes.withColumn("child", F.explode(children)).select("kind", F.slice("parts", 2, STRETCHES).alias("parts"), "docs", "child.node", "child.fields")


def recurring_kinds(found: DataFrame, min_docs: int) -> DataFrame:
    """(kind): names of the different lines of (masked, doc_id) that belong to a recurring template."""
    few = Window.partitionBy("masked").orderBy("doc_id")
    first = found.select("masked", "doc_id").distinct().withColumn("at", F.row_number().over(few)).filter(F.col("at") <= min_docs)
    kinds = first.groupBy("masked").agg(F.collect_list(F.struct("doc_id")).alias("docs"))  # a struct, as a list drops nulls
    cut = stretches(kinds)
    nodes = settle(cut.select(_name(F.col("masked")).alias("kind"), "parts", "docs", _name(*upper()).alias("node"), "fields"))
    whole = []
    for _ in range(0, STRETCHES, 2):
        children = grown(grown(nodes))
        each = children.select("node", F.explode("docs").alias("doc")).distinct()
        often = settle(each.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("node"))
        alive = settle(children.join(often, "node", "left_semi"))
        whole.append(alive.filter(F.size("parts") == 0).select("kind"))
        nodes = alive.filter(F.size("parts") > 0)
    return reduce(DataFrame.unionByName, whole).distinct()


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, pos): lines to drop."""
    each = settle(lines(docs).withColumn("upper", F.xxhash64(*upper())))  # the texts are parsed once
    # 64 bits, as lines that share them by chance only go further down the tree
    light = each.select("upper", "doc_id").distinct()
    # settled, so that the join below is between plain exchanges and AQE can split a node that very many lines share
    shared = settle(light.groupBy("upper").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("upper"))
    found = settle(each.join(shared, "upper", "left_semi").drop("upper"))
    kinds = settle(recurring_kinds(found, min_docs))
    return found.select("key", "pos", _name(F.col("masked")).alias("kind")).join(kinds, "kind", "left_semi").select("key", "pos")


def without_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text."""
    # a digest of the row numbers it, the same in every scan; rows that share it are equal and lose the same lines
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    gone = recurring(keyed, min_docs).distinct().groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
    whole = keyed.join(gone, "key", "left")
    parts = _split(F.col("text"))
    # pieces between dropped lines, each a slice: linear in the number of lines
    edges = F.concat(F.array(F.lit(-1)), F.coalesce("gone", F.array().cast("array<int>")), F.array(F.size(parts)))
    between = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.slice("parts", F.col("edges")[i - 1] + 2, F.col("edges")[i] - F.col("edges")[i - 1] - 1))
    cut = whole.select("doc_id", parts.alias("parts"), edges.alias("edges"))
    return cut.select(
        "doc_id", F.size("parts").cast("long").alias("n_lines"), (F.size("edges") - 2).cast("long").alias("n_dropped"),
        F.array_join(F.flatten(between), "\n").alias("kept_text"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_recurring(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), e AS (
  SELECT doc_id, i AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)
), l AS (
  SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM e
), t AS (
  SELECT *, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n, array_to_string(string_split(masked, ' ')[1:3], ' ') AS lead FROM l WHERE masked <> ''
), k AS (
  SELECT DISTINCT masked, tokens, n, lead, n * 30 // 100 AS most, greatest(1, (n * 30 // 100) // 2) AS w FROM t
), p AS (
  -- every choice of at most two stretches as fields, written out as the text of its template; the lead is never one
  SELECT k.*, i, j FROM k, range(-1, 10) a(i), range(-1, 10) b(j)
  WHERE (j = -1 OR i < j) AND (j > -1 OR i = -1) AND (j = -1 OR 3 + j * w < n)
    AND (CASE WHEN j = -1 THEN 0 WHEN i = -1 THEN 1 ELSE 2 END) <= most
), q AS (
  SELECT masked, n || ':' || array_to_string(list_transform(tokens, lambda x, place:
    CASE WHEN place > 3 AND ((place - 4) // w = i OR (place - 4) // w = j) THEN chr(10) ELSE x END), ' ') AS template FROM p
), m AS (
  SELECT masked, template FROM q WHERE template IN (SELECT template FROM q JOIN (SELECT DISTINCT masked, doc_id FROM t) USING (masked) GROUP BY template HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '-')) >= 3)
), r AS (
  SELECT DISTINCT masked FROM m
), gone AS (
  SELECT t.doc_id, t.pos FROM t JOIN r USING (masked)
)
SELECT e.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped,
  sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.pos = gone.pos GROUP BY e.doc_id
"""
