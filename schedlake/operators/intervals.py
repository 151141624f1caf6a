"""Points in intervals, and scans along one order that has no key to divide it by.

Intervals of any length on a whole-number axis (seconds, microseconds, days) are cut into blocks whose length is a power of two and that
start at a multiple of it: at most two of each length. A point lies in exactly one block of each length, so points and intervals
meet by equality, whatever the intervals' lengths and however they overlap. Totals over the intervals that hold a point need no
pairs: each block is totalled once, and a point adds up the totals of its blocks.

Scans over one unpartitioned order (last value, running maximum, islands) run in two passes: the order is cut into ranges,
each range is scanned by itself and summed up in one row, the few summaries are scanned, and what they carry is joined to the
ranges' rows. No task sees the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.session import cut_lineage

#: Lengths of blocks: 2 ** 0 to 2 ** LEVELS; the axis may span that much. Microseconds since 1970 stay below 2 ** 52 for a century.
LEVELS = 56
#: Up to so many blocks of intervals are sent to all executors; more are joined by shuffling.
FEW_BLOCKS = 10_000
#: Totals over the intervals that contain a point: of the intervals of a block, and of the totals of several blocks.
TOTALS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
#: Rows that one range of a scan holds, on average; beyond so many ranges they grow to the second size.
RANGE_ROWS, MANY_RANGES, LARGE_RANGE_ROWS = 20_000, 2_000, 1_000_000


def dyadic_blocks(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """``intervals`` with a row per block: ``block_level`` (its length is 2 ** level) and ``block`` (its number).

    Both ends belong to an interval and are whole numbers. Rows whose start lies behind their end, or is null, have no block.
    At each level from the smallest up, an odd first block and an even last block are taken; what is left is halved.
    """
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    level = F.sequence(F.lit(0), F.lit(LEVELS))

    def taken(k: Column) -> Column:
        # what the smaller blocks left over; an odd first and an even last block have no whole block above them
        step = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first = F.call_function("shiftright", lo + step - 1, k)
        last = F.call_function("shiftright", hi + 1, k) - 1
        odd = F.when((first <= last) & (first % 2 != 0), first)
        even = F.when((first <= last) & (last % 2 == 0), last)
        both = F.array_compact(F.array(odd, even))
        return F.transform(both, lambda b: F.struct(k.alias("block_level"), b.alias("block")))

    blocks = F.when(lo <= hi, F.flatten(F.transform(level, taken)))
    return intervals.select("*", F.inline(blocks))


def containing(
    points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, scope: list[str] = [], how: str = "inner",
    totals: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Every point with every interval that contains it (both ends included), in the same ``scope`` where one is given.

    Points are looked up once per block length that the intervals use, at most LEVELS + 1, however long the intervals are.
    With ``how`` left, points in no interval stay with nulls.

    ``totals`` (name: a kind of TOTALS and a column of the intervals) asks for totals over the containing intervals in place of the
    intervals: each point comes once. Blocks are totalled before points look them up, so the work grows with the rows, not with the pairs.
    """
    if totals:
        return _totalled(points, at, intervals, start, end, scope, how, totals)
    placed = cut_lineage(dyadic_blocks(intervals, start, end))
    asked = points if how == "inner" else cut_lineage(points.withColumn("__row", F.monotonically_increasing_id()))
    met = _met(asked, at, placed, scope)
    if how == "inner":
        return met
    found = met.select("__row", *[c for c in intervals.columns if c not in scope])
    return asked.join(found, "__row", "left").drop("__row")


def _met(points: DataFrame, at: str, placed: DataFrame, scope: list[str]) -> DataFrame:
    """Every point with every row of ``placed`` (a settled table) whose block holds it.

    Spark judges the points' side by the size it had before each point became a row per block length, and would send it whole
    through the driver; so the join is merged by key unless the blocks are few.
    """
    used = dict(placed.groupBy("block_level").agg(F.count(F.lit(1))).collect())  # at most LEVELS + 1 rows
    position = F.col(at).cast("long")
    ancestors = F.array(*[F.struct(F.lit(k).alias("block_level"), F.call_function("shiftright", position, F.lit(k)).alias("block")) for k in sorted(used)])
    ancestors = ancestors.cast("array<struct<block_level:int,block:bigint>>")
    blocks = F.broadcast(placed) if sum(used.values()) <= FEW_BLOCKS else placed.hint("merge")
    return points.filter(F.col(at).isNotNull()).select("*", F.inline(ancestors)).join(blocks, [*scope, "block_level", "block"]).drop("block_level", "block")


def _totalled(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, scope: list[str], how: str, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    first, again = ({n: TOTALS[kind][i] for n, (kind, _) in totals.items()} for i in (0, 1))
    lo, hi = F.col(start).cast("long").alias("__lo"), F.col(end).cast("long").alias("__hi")
    rows = intervals.select(*scope, lo, hi, *[c.alias(n) for n, (_, c) in totals.items()]).filter("__lo <= __hi")
    # neighbours share blocks: side by side in one task, they leave it as few totals
    blocks = dyadic_blocks(rows.repartitionByRange(*scope, "__lo"), "__lo", "__hi")
    placed = cut_lineage(blocks.groupBy(*scope, "block_level", "block").agg(*[f(n).alias(n) for n, f in first.items()]))
    asked = cut_lineage(points.withColumn("__at", F.col(at).cast("long")))
    places = asked.select(*scope, "__at").distinct()
    found = _met(places, "__at", placed, scope).groupBy(*scope, "__at").agg(*[f(n).alias(n) for n, f in again.items()])
    met = asked.join(found, [*scope, "__at"], how)
    out = [F.coalesce(n, F.lit(0)).alias(n) if kind == "count" else F.col(n) for n, (kind, _) in totals.items()]
    return met.select(*points.columns, *out)


def _ranged(table: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``__range``: ranges ascend with ``order``, and equal values may not be divided. Settled, so that both passes agree."""
    settled = cut_lineage(table)
    rows = settled.count()
    parts = max(1, min(-(-rows // RANGE_ROWS), MANY_RANGES), -(-rows // LARGE_RANGE_ROWS))
    return cut_lineage(settled.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))


def last_value(rows: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add, per name in ``values``, the last non-null value up to and including the row along ``order`` (a total order)."""
    ranged = _ranged(rows.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]), order)
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*order)
    ends = ranged.groupBy("__range").agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), key)).alias(f"__e_{n}") for n in values])
    # one row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__range", *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values])
    joined = ranged.join(carried, "__range")
    out = [F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(inside), F.col(f"__c_{n}")).alias(n) for n in values]
    return joined.select(*rows.columns, *out)


def running_max(rows: DataFrame, order: list[str], value: str, name: str, earlier: bool = False) -> DataFrame:
    """Add the largest ``value`` up to the row along ``order``, without the row itself where ``earlier``."""
    ranged = _ranged(rows, order)
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if earlier else Window.currentRow)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("__range").agg(F.max(value).alias("__m")).select("__range", F.max("__m").over(before).alias("__c"))
    return ranged.join(carried, "__range").select(*rows.columns, F.greatest(F.max(value).over(inside), "__c").alias(name))


def islands(rows: DataFrame, order: list[str], start: str, end: str, gap: int, name: str = "island") -> DataFrame:
    """Add the number (from 1, along ``order``) of the row's island: a new one begins where ``start`` lies more than ``gap`` behind
    every earlier row's ``end``. ``order`` is total and begins with ``start``."""
    reach = running_max(rows, order, end, "__reach", earlier=True)
    opened = reach.withColumn("__new", F.coalesce(F.col(start) > F.col("__reach") + gap, F.lit(True)).cast("long")).drop("__reach")
    ranged = _ranged(opened, order)
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("__range").agg(F.sum("__new").alias("__m")).select("__range", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__c"))
    return ranged.join(carried, "__range").select(*rows.columns, (F.sum("__new").over(inside) + F.col("__c")).alias(name))
