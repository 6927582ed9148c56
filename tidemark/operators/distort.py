"""Arrival distortion: which rows of a run arrive late, by how much, and in what order.

A run is identified by the columns RUN; all its rows are in one DataFrame together with those of
other runs, so a whole grid is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import digest, ranked, uniform
from tidemark.operators.rules import with_marks

RUN = ["rule", "fraction", "multiple", "structure", "seed"]


def grid(spark: SparkSession, rules, fractions, multiples, seeds, structures=("random", "targeted", "delete")) -> DataFrame:
    """One row per run. Deleting has no delay, so it comes once per fraction and seed."""
    rows = [(r.name, f, None if s == "delete" else float(m), s, x) for r in rules for f in fractions for s in structures for m in ((0,) if s == "delete" else multiples) for x in seeds]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "run int, rule string, fraction double, multiple double, structure string, seed int")


def spread(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """The projected stream once per run of its rule; the grid is the caller's short list."""
    return projected.join(F.broadcast(runs), "rule")


def draws(projected: DataFrame, runs: DataFrame) -> DataFrame:
    """The projected stream once per (rule, seed, kind) of the runs, kind telling targeted from other
    structures: with ``rank``, each eligible row's place in the drawn order, and ``eligible``, the
    number of such rows. Which rows a run moves depends neither on how far, nor on what happens to
    them, nor but for their number on the fraction. Eligible are all rows or, for targeted runs, those
    ``marked`` (see ``rules.with_marks``); a targeted run without eligible rows does not exist."""
    projected = projected if "marked" in projected.columns else with_marks(projected)
    few = runs.select("rule", "seed", (F.col("structure") == "targeted").alias("targeted")).distinct()
    rows = projected.join(F.broadcast(few.withColumn("draw", F.concat_ws("/", "rule", "seed", "targeted"))), "rule")
    rows = rows.withColumn("_h", F.when(~F.col("targeted") | F.col("marked"), digest("pick", F.col("seed"), F.col("seq"))))
    sizes = F.broadcast(rows.groupBy("draw").agg(F.count("_h").alias("eligible")).where("eligible > 0"))  # a row per draw
    drawn = ranked(rows.where("_h IS NOT NULL"), "draw", "_h", "seq")
    rest = rows.where("_h IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).join(sizes, "draw").drop("_h", "draw")


def chosen(drawn: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``draws`` once per run, with ``chosen``: exactly max(1, floor(n * fraction)) of
    the eligible ones. Random and delete share their rows; the runs are the caller's short list."""
    each = drawn.join(F.broadcast(runs.withColumn("targeted", F.col("structure") == "targeted")), ["rule", "seed", "targeted"])
    few = F.greatest(F.lit(1), F.floor(F.col("eligible") * F.col("fraction")))
    return each.withColumn("chosen", F.coalesce(F.col("rank") <= few, F.lit(False))).drop("rank", "eligible", "targeted")


def fixed(w: Column, multiple: Column) -> Column:
    return F.round(multiple * w).cast("long")


def uniform_delay(w: Column, multiple: Column, seed: Column, seq: Column) -> Column:
    """Uniform on [0, 2D)."""
    return F.round(2 * multiple * w * uniform(digest("delay", seed, seq))).cast("long")


def lognormal_delay(w: Column, multiple: Column, seed: Column, seq: Column) -> Column:
    """Mean D, sigma 1: exp(ln D - 1/2 + z), z by Box-Muller on two draws."""
    h = digest("delay", seed, seq)
    u, v = (F.floor(uniform(h) * 4294967296.0) + 1) / 4294967296.0, uniform(h, 9)
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return F.round(F.exp(F.log(multiple * w) - 0.5 + z)).cast("long")


def arrive(rows: DataFrame, delay: Column | None = None, clock: str = "M1") -> DataFrame:
    """``rows`` as the rule sees them: ``arr`` orders them (ties by seq), ``occ`` is the event time
    it compares. M1 keeps the time of occurrence, M2 takes that of arrival. Deleted rows are gone."""
    if clock not in ("M1", "M2"):
        raise ValueError(f"unknown clock model {clock}")
    late = fixed(F.col("w"), F.col("multiple")) if delay is None else delay
    moved = rows.where("NOT (structure = 'delete' AND chosen)")
    moved = moved.withColumn("arr", F.col("t") + F.when(F.col("chosen") & (F.col("structure") != "delete"), late).otherwise(F.lit(0)))
    return moved.withColumn("occ", F.col("t") if clock == "M1" else F.col("arr"))


def burst(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chosen`` by whole slots of length W: slots in a seeded order, taken until at
    least max(1, floor(n * fraction)) rows are."""
    first = rows.groupBy("run").agg(F.min("t").alias("_t0"), F.count("*").alias("_n"))  # a row per run
    slotted = rows.join(F.broadcast(first), "run").withColumn("_slot", F.floor((F.col("t") - F.col("_t0")) / F.col("w")))
    slots = slotted.groupBy("run", "_slot").agg(F.count("*").alias("_c"), F.first("_n").alias("_m"), F.first("fraction").alias("_f"), F.first("seed").alias("_x"))
    order = Window.partitionBy("run").orderBy(digest("slot", F.col("_x"), F.col("_slot")), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("_c").over(order), F.lit(0)) < F.greatest(F.lit(1), F.floor(F.col("_m") * F.col("_f")))
    slots = slots.select("run", "_slot", taken.alias("chosen"))
    return slotted.join(slots, ["run", "_slot"]).drop("_t0", "_n", "_slot")


def bernoulli(rows: DataFrame) -> DataFrame:
    """``rows`` with ``chosen``: each with probability ``fraction``."""
    return rows.withColumn("chosen", uniform(digest("pick", F.col("seed"), F.col("seq"))) < F.col("fraction"))
