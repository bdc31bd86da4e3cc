"""Running totals, places and neighbours of rows in groups of any size.

A window over a whole group is one task for it. Here a group is cut into blocks of consecutive values of its order: a
small table of the blocks' sums or borders is gone through in order, and windows see a block each. Blocks depend on
values only, so results are the same however rows are dealt out.

`order` is an integer column whose values are distinct within a group and not too far apart: a block holds `width` of
them at most. Rows whose order is null are one block, before the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _blocks(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / width))


def _by(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of a table of blocks; groups may be null."""
    keys = [*by, "_block"]
    other = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in table.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(other, same).drop(*(f"_k{i}" for i in range(len(keys))))


def running_total(df: DataFrame, by: list[str], order: str, value: Column, name: str, *, width: int = WIDTH) -> DataFrame:
    """df with `name`: the sum of value over the rows of its group (columns `by`) up to this one."""
    rows = _blocks(df, order, width).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _by(rows, sums, by).withColumn(name, F.col("_before") + F.sum("_value").over(inside)).drop("_block", "_value", "_before")


def places(df: DataFrame, by: list[str], order: str, name: str, *, width: int = WIDTH) -> DataFrame:
    """df with `name`: the place of each row in its group, from 0."""
    return running_total(df, by, order, F.lit(1), name, width=width).withColumn(name, F.col(name) - 1)


def neighbours(df: DataFrame, by: list[str], order: str, value: Column, before: str, after: str, *, width: int = WIDTH) -> DataFrame:
    """df with the values of the rows before and after each; null where there is none."""
    rows = _blocks(df, order, width).withColumn("_value", value)
    borders = rows.groupBy(*by, "_block").agg(F.min_by("_value", order).alias("_first"), F.max_by("_value", order).alias("_last"))
    blocks, inside = Window.partitionBy(*by).orderBy("_block"), Window.partitionBy(*by, "_block").orderBy(order)
    borders = borders.withColumns({"_left": F.lag("_last").over(blocks), "_right": F.lead("_first").over(blocks)}).drop("_first", "_last")
    out = _by(rows, borders, by).withColumn("_place", F.row_number().over(inside))
    last = F.lead("_place").over(inside).isNull()
    out = out.withColumns({before: F.when(F.col("_place") == 1, F.col("_left")).otherwise(F.lag("_value").over(inside)), after: F.when(last, F.col("_right")).otherwise(F.lead("_value").over(inside))})
    return out.drop("_block", "_value", "_left", "_right", "_place")


def nearest(df: DataFrame, by: list[str], order: str, value: str, before: str, after: str, *, width: int = 1 << 20) -> DataFrame:
    """df with structs (order, value) of the last row with a value at or before each, and of the first at or after it; of
    several at one place, that of the smallest value. They hold for rows without a value of their own.

    All frames start at the first row: one that ends at the last row is gone through anew for each row, in quadratic time.
    """
    held = F.when(F.col(value).isNotNull(), F.struct(order, value))
    rows = _blocks(df, order, width).withColumn("_held", held)
    edge = lambda at: F.min_by("_held", F.when(F.col("_held").isNotNull(), F.struct(at.alias("at"), F.col(value).alias("value"))))
    edges = rows.groupBy(*by, "_block").agg(edge(-F.col(order)).alias("_last"), edge(F.col(order)).alias("_first"))
    so_far = lambda c, keys, orders, end: F.last(c, True).over(Window.partitionBy(*keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, end))
    edges = edges.withColumns({"_left": so_far("_last", by, ["_block"], -1), "_right": so_far("_first", by, [F.desc("_block")], -1)}).drop("_first", "_last")
    inside, smallest = [*by, "_block"], F.desc_nulls_last(value)
    out = _by(rows, edges, by)
    out = out.withColumn(before, F.coalesce(so_far("_held", inside, [order, smallest], 0), "_left"))
    return out.withColumn(after, F.coalesce(so_far("_held", inside, [F.desc(order), smallest], 0), "_right")).drop("_block", "_held", "_left", "_right")
