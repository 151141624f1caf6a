"""Rankings that stay balanced when one key holds a large share of the rows.

Joins are plain joins: where one key is hot, AQE splits the partitions of that key (``session.SETTINGS``) and nothing is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the ranges of a unique whole-number order: no range holds more rows than this.
RANGE_WIDTH = 20_000


def order_range(order: str, width: int = RANGE_WIDTH) -> Column:
    """Range that a value falls into, from the value alone. Unique whole numbers put at most ``width`` rows into a range."""
    return F.floor(F.col(order) / width)


def spread_row_number(df: DataFrame, keys: list[str], order: str, name: str, width: int = RANGE_WIDTH) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without putting one key into one task.

    Rows are ranked inside (key, range of ``order``); the counts of the earlier ranges of
    the key, one number per used range, are added. ``order`` must be a unique whole number,
    ``keys`` non-null.
    """
    ranged = df.withColumn("__range", order_range(order, width))
    group = [*keys, "__range"]
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return (
        ranged.withColumn("__inside", inside)
        .join(offsets.drop("__n"), group)
        .withColumn(name, (F.col("__inside") + F.col("__before")).cast("long"))
        .drop("__range", "__inside", "__before")
    )


def first_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """Top k rows per key. The row_number filter lets Spark keep k rows per key in every map task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
