"""Previous-row values and running sums without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_lag(
    df: DataFrame, keys: list[str], order: str, block: Column, value: str, out: str
) -> DataFrame:
    """``lag(value) OVER (PARTITION BY keys ORDER BY order)`` in two levels.

    Rows are sorted only inside ``(keys, block)``; the last value of every block
    travels through one row per block. ``block`` must be non-decreasing in
    ``order``, which itself must be unique inside ``keys``. A key that holds a
    third of the table is thus spread over its blocks.
    """
    keyed = df.withColumn("_block", block)
    last = keyed.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    ).drop("_last")
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        keyed.withColumn("_first", F.row_number().over(inner) == 1)
        .withColumn("_previous", F.lag(value).over(inner))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_previous")))
        .drop("_block", "_first", "_previous", "_carry")
    )


def block_running_sum(
    df: DataFrame, keys: list[str], order: str, block: Column, value: str, out: str
) -> DataFrame:
    """``sum(value) OVER (PARTITION BY keys ORDER BY order)`` in two levels.

    Same contract as ``block_lag``: block totals are accumulated over one row
    per block, rows only inside their block.
    """
    keyed = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        keyed.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("_running", F.sum(value).over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.col("_running") + F.col("_before"))
        .drop("_block", "_running", "_before")
    )
