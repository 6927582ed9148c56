"""A bounded reorder buffer, as a sort.

An arrival at A releases every held event of occurrence A - B or earlier, in the order of occurrence
and arrival; the end releases the rest. So an event leaves at the later of its own arrival and the
first arrival at occurrence + B or later, which is found in slices of arrival time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.slicing import AUTO, previous, slice_number, width_of

#: The order of release, for ``detect``.
ORDER = ["arr", "rel_seq", "occ", "came", "seq"]
END = (1 << 63) - 1


def buffered(rows: DataFrame, buffer_us: str = "buffer", width=AUTO) -> DataFrame:
    """``rows`` (run, arr, occ, seq, buffer) with ``released``, the time of the releasing arrival,
    null for what the end releases, and (``rel_arr``, ``rel_seq``), the releasing arrival."""
    width = width_of(rows, ["run"], "arr") if width is AUTO else width
    size = F.when(F.col(buffer_us) < 0, F.raise_error(F.lit("a buffer is 0 or more")).cast("long")).otherwise(F.col(buffer_us))
    place = slice_number(F.col("arr"), width)
    arrivals = rows.select("run", "arr", F.lit(1).alias("_kind"), "seq", F.struct("arr", "seq").alias("_at")).withColumn("_s", place)
    probes = rows.select("run", (F.col("occ") + size).alias("arr"), F.lit(0).alias("_kind"), "seq", F.lit(None).cast("struct<arr:bigint,seq:bigint>").alias("_at")).withColumn("_s", place)
    # backwards in time, the latest arrival seen so far is the first one to come: one pass
    back = Window.partitionBy("run", "_s").orderBy(F.desc("arr"), F.desc("_kind"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = arrivals.unionByName(probes)
    found = both.withColumn("_first", F.last("_at", ignorenulls=True).over(back)).where("_kind = 0")
    if width is not None:  # else the first arrival of the next slice that has one
        firsts = both.groupBy("run", "_s").agg(F.min("_at").alias("_at"))
        after = Window.partitionBy("run").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
        heads = firsts.select("run", "_s", F.last("_at", ignorenulls=True).over(after).alias("_next"))
        found = found.join(heads, ["run", "_s"]).withColumn("_first", F.coalesce("_first", "_next"))
    found = found.select("run", "seq", "_first")
    at = F.when(F.col("_first").isNotNull(), F.greatest("_first", F.struct("arr", "seq")))
    return rows.join(found, ["run", "seq"]).withColumn("_out", at).select(*rows.columns, F.col("_out.arr").alias("rel_arr"), F.col("_out.seq").alias("rel_seq"), F.col("_out.arr").alias("released"))


def released_order(out: DataFrame) -> DataFrame:
    """``out`` as a stream that arrives as it is released; its order is ORDER."""
    return out.withColumn("came", F.col("arr")).withColumn("arr", F.coalesce("rel_arr", F.lit(END))).withColumn("rel_seq", F.coalesce("rel_seq", F.lit(END))).drop("rel_arr")


def in_order(rows: DataFrame, order: list[str] = ["arr", "seq"], strictly: bool = False, width=AUTO) -> DataFrame:
    """(run, ordered): is the event time never less (or always more) than before?"""
    kept = rows.select("run", *dict.fromkeys([*order, "occ"]))
    pairs = previous(kept, ["run"], order, order[0], "occ", "_last", width)
    good = F.col("occ") > F.col("_last") if strictly else F.col("occ") >= F.col("_last")
    return pairs.groupBy("run").agg(F.bool_and(F.coalesce(good, F.lit(True))).alias("ordered"))
