"""Rows by their position in a long ordered series, without one task for a series.

A series is numbered in two steps: rows within (series, time block), and blocks
by their counts. Numbered rows are then dealt out in blocks of equal size, each
with the rows before it that a window reaches back to, so a series of any
length spreads over many tasks and every window sees all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of a numbered series.
BLOCK = 1 << 16


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], unit: str = "month", name: str = "rn") -> DataFrame:
    """``df`` with the position of each row (from 1) in its series; ``order[0]`` is a time, cut into blocks of ``unit``."""
    df = df.withColumn("_block", F.date_trunc(unit, F.col(order[0])))
    inside = W.partitionBy(*by, "_block").orderBy(*order)
    before = W.partitionBy(*by).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    keys = [*by, "_block"]
    counts = counts.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "_before")
    match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    joined = df.withColumn("_row", F.row_number().over(inside)).join(counts, match)
    return joined.select(*(c for c in df.columns if c != "_block"), (F.col("_row") + F.col("_before")).alias(name))


def reaching_back(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, make, unit: str = "month") -> DataFrame:
    """``make(df, window)`` over windows that look back at most ``rows`` rows of the series.

    ``make`` gets rows with ``rn`` and a window specification partitioned and
    ordered, without a frame.
    """
    size = max(BLOCK, rows)
    n = numbered(df, by, order, unit)
    block = F.floor((F.col("rn") - 1) / size)
    # the last rows of a block are also shown to the next one
    tail = F.col("rn") - block * size > size - rows
    dealt = n.withColumn("_of", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))))
    spec = W.partitionBy(*by, "_of").orderBy("rn")
    return make(dealt, spec).where(F.col("_of") == block).drop("_of")
