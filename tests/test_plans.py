"""Plan rules for all registered queries and balance of the large operators under a hot key."""

import io
import re
import sys
from contextlib import redirect_stdout

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from schedlake import session
from schedlake.operators import stats as S
from schedlake.operators.skew import first_rows

QUERIES = entry.QUERIES
#: Queries that run Python: NFKC and the order-dependent matcher.
PYTHON = {"text_normalize", "address_search", "stable_ids"}


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def settled(monkeypatch):
    """Plans of the intermediate tables that a query writes, in order."""
    plans, real = [], session.cut_lineage

    def spy(df):
        plans.append(plan(df))
        return real(df)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("schedlake.") and getattr(module, "cut_lineage", None) is real:
            monkeypatch.setattr(module, "cut_lineage", spy)
    return plans


def test_intermediate_plans_are_seen(spark, settled):
    QUERIES["address_search"](spark, SF)
    assert len(settled) > 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_no_row_python(spark, settled, name):
    """The rules hold for the returned plan and for every intermediate table."""
    last = plan(QUERIES[name](spark, SF))
    text = "\n".join([*settled, last])
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON:
        assert "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(QUERIES["multi_parent"](spark, SF))
    assert "p_name" not in text
    text = plan(QUERIES["hour_histogram"](spark, SF))
    assert "o_totalprice" not in text and "c_acctbal" not in text
    text = plan(spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'O'").select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert plan(first_rows(df, ["k"], ["id"], 2)).count("WindowGroupLimit") >= 2


def test_hot_point_is_reduced_before_the_shuffle(spark):
    """One point with most entries: the exchange after the partial aggregation carries a few rows only."""
    entries = spark.range(0, 20000, numPartitions=4).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("ord"),
        F.lit("garbage").alias("kind"),
        (F.col("id") % 7 + 1).cast("int").alias("weekday"),
        F.lit("08:00").alias("arrive"),
        F.lit(None).cast("string").alias("depart"),
    )
    profile = S.point_profile(entries, "ord", hours=True)
    assert re.search(r"HashAggregate.*\n.*Exchange.*\n.*HashAggregate", plan(profile)) or "partial_bit_or" in plan(profile)
    assert profile.filter("ord = 1").first().n_garbage >= 13333


def test_pairs_per_task_are_bounded(spark, monkeypatch):
    """Keys and parents are dealt into more tasks as they grow, and are not told apart in the tasks of the step before."""
    from schedlake.operators import quality

    monkeypatch.setattr(quality, "PAIR_ROWS", 40)
    rows = [(None if i % 11 == 0 else i % 60, None if i % 13 == 0 else i % 7) for i in range(900)] * 2 + [(1000, 1)] * 3
    df = spark.createDataFrame(rows, "k int, p int").distinct()
    want = {}
    for k, p in rows:
        want.setdefault(k, set()).add(p)
    for expected in (None, len(rows)):
        got = quality.multi_parent(df, "k", "p", expected)
        assert {r.k: r.parents for r in got.collect()} == {k: len(v) for k, v in want.items() if len(v) > 1}
        parts = int(re.search(r"hashpartitioning\(k#\d+, p#\d+, (\d+)\), REPARTITION_BY_NUM", plan(got)).group(1))
        assert parts >= len(set(rows)) / 40 and parts >= (expected or 0) / 40
