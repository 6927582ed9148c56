"""Seeded draws that depend on row identity alone: the same rows in any partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_BITS = 12


def digest(salt: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(salt), *[p.cast("string") for p in parts]).cast("binary"))


def word(h: Column, at: int = 1) -> Column:
    """32 bits of a hexadecimal digest."""
    return F.conv(F.substring(h, at, 8), 16, 10).cast("long")


def uniform(h: Column, at: int = 1) -> Column:
    """In [0, 1)."""
    return word(h, at) / F.lit(4294967296.0)


def ranked(df: DataFrame, run: str, h: str, tie: str) -> DataFrame:
    """``df`` with ``rank``, the place of each row in its run by (h, tie), from 1. Rows are ranked in
    slices of the digest's range and the slices' sizes summed up, so a run may have any size."""
    rows = df.withColumn("_slice", F.conv(F.substring(h, 1, PREFIX_BITS // 4), 16, 10).cast("int"))
    before = F.sum("count").over(Window.partitionBy(run).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(run, "_slice").count().select(run, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(run, "_slice").orderBy(h, tie))
    return rows.withColumn("_own", own).join(sizes, [run, "_slice"]).select(*df.columns, (F.col("_own") + F.col("_before")).alias("rank"))
