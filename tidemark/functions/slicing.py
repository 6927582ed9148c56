"""Sequential work in slices: a group of any size is cut by a number that orders it, each slice is
worked on by itself, and what a slice has to know of those before it is carried over."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one slice may have.
SLICE_ROWS = 500_000
#: The width is measured, at the price of a job.
AUTO = object()


#: Boundaries that travel with a plan; beyond, those of all groups together are taken.
MOST_BOUNDS = 100_000


def width_of(rows: DataFrame, by: list[str], x: str, most: int = SLICE_ROWS) -> np.ndarray | None:
    """Boundaries of slices of ``x`` at which no group has much more than ``most`` rows in a slice: the
    quantiles of each group that is larger, so that slices follow bursts. None if no group is. Rows of
    equal ``x`` stay together."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    largest, groups = sizes.agg(F.max("_n"), F.count("*")).first()
    if not groups:
        return None
    parts = -(-largest // most)
    share = F.percentile_approx(x, [k / parts for k in range(1, parts)], 20 * parts)
    if groups * parts <= MOST_BOUNDS:
        found = rows.join(sizes.select(*by), by, "left_semi").groupBy(*by).agg(share.alias("_b")).collect()
    else:
        found = rows.agg(share.alias("_b")).collect()
    return np.unique([b for r in found for b in r["_b"]])


def slice_number(x: Column, width: int | np.ndarray | None) -> Column:
    """The slice of ``x``: by equal widths, or how many boundaries are not above it (a binary search)."""
    if width is None:
        return F.lit(0).cast("long")
    if isinstance(width, int):
        return F.floor(x / width)
    bounds, steps = F.lit(width), [1 << k for k in range(len(width).bit_length() - 1, -1, -1)]
    further = lambda at, step: (at + step <= len(width)) & F.coalesce(F.get(bounds, at + step - 1) <= x, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at)).cast("long")


def sliced(rows: DataFrame, by: list[str], x: str, width) -> tuple[DataFrame, bool]:
    """``rows`` with the slice number ``_s``, and whether there is more than one."""
    width = width_of(rows, by, x) if width is AUTO else width
    return rows.withColumn("_s", slice_number(F.col(x), width)), width is not None


def before(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def carried(slices: DataFrame, by: list[str], value: Column, name: str, backwards: bool = False) -> DataFrame:
    """``by``, ``_s`` and ``name``: an aggregate over the slices before (or after) each; slices are few."""
    own = Window.partitionBy(*by).orderBy(F.desc("_s") if backwards else "_s").rowsBetween(Window.unboundedPreceding, -1)
    return slices.select(*by, "_s", value.over(own).alias(name))


def running(rows: DataFrame, by: list[str], order: list[str], x: str, aggregate, value: str, name: str, width=AUTO) -> DataFrame:
    """``rows`` with ``name``: the aggregate (F.sum or F.max) of ``value`` over the rows before each
    in its group, null for the first. ``x`` is the first column of the order."""
    cut, many = sliced(rows, by, x, width)
    own = cut.withColumn(name, aggregate(value).over(before(by, order)))
    if not many:
        return own.drop("_s")
    slices = cut.groupBy(*by, "_s").agg(aggregate(value).alias("_v"))
    both = own.join(carried(slices, by, aggregate("_v"), "_c"), [*by, "_s"])
    join = F.greatest(name, "_c") if aggregate is F.max else F.coalesce(F.col(name) + F.col("_c"), name, "_c")
    return both.withColumn(name, join).drop("_s", "_c")


def previous(rows: DataFrame, by: list[str], order: list[str], x: str, value: str, name: str, width=AUTO) -> DataFrame:
    """``rows`` with ``name``: the value of the row before each in its group, null for the first."""
    cut, many = sliced(rows, by, x, width)
    own = cut.withColumn(name, F.lag(value).over(Window.partitionBy(*by, "_s").orderBy(*order)))
    if not many:
        return own.drop("_s")
    place = F.struct(*order)
    slices = cut.groupBy(*by, "_s").agg(F.max_by(F.struct(F.col(value).alias("v")), place).alias("_v"), F.min(place).alias("_first"))
    last = F.last("_v", ignorenulls=True)
    own_slices = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    heads = slices.select(*by, "_s", last.over(own_slices).alias("_c"), "_first")
    both = own.join(heads, [*by, "_s"])
    return both.withColumn(name, F.when(place == F.col("_first"), F.col("_c.v")).otherwise(F.col(name))).drop("_s", "_c", "_first")


def numbered(rows: DataFrame, by: list[str], order: list[str], x: str, name: str, width=AUTO) -> DataFrame:
    """``rows`` with ``name``: the place of each in its group, from 1."""
    return running(rows.withColumn("_one", F.lit(1)), by, order, x, F.sum, "_one", "_before", width).withColumn(name, F.coalesce("_before", F.lit(0)).cast("long") + 1).drop("_one", "_before")
