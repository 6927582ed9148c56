"""Parameter sweeps: one job over all runs of a grid, compared with the undistorted baseline.

The stream is kept once, with what each run moves, and all runs are evaluated where a key's rows meet:
see ``operators.compact``. An event that was not delayed is never late, and none is in runs whose delays stay
within one window, in runs that delete, and where the rule sees arrival times: nothing is looked up for
those. The baseline is one cell more of each rule. Where alerts are asked for, subjects are the keys that have one.

Which subjects are marked is the caller's to say: ``marked`` is a condition on the projected stream or a
DataFrame whose first column has their pids; without it, the marks of the ``events`` table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.slicing import width_of
from tidemark.operators import compact, detect, distort
from tidemark.operators.rules import project, with_marks
from tidemark.sources.scratch import cut

FRACTIONS, MULTIPLES, SEEDS = (0.05, 0.2), (0.5, 1.0, 2.0), (0, 1, 2)
DELAYS = {
    "fixed": lambda w, multiple, seed, seq: distort.fixed(w, multiple),
    "uniform": distort.uniform_delay,
    "lognormal": distort.lognormal_delay,
    "burst": lambda w, multiple, seed, seq: distort.fixed(w, multiple),
}
#: Delays that are the same for all rows that a run moves.
EVEN = ("fixed", "burst")
#: What the rules look at.
SEEN = ["run", "key", "seq", "arr", "occ", "w", "n"]


def numbers(spark: SparkSession, rules) -> DataFrame:
    """(rule, run): the runs of the undistorted stream, -1, -2, ... by the name of the rule."""
    return spark.createDataFrame([(n, -k) for k, n in enumerate(sorted({r.name for r in rules}), 1)], "rule string, run int")


def plain(projected: DataFrame, rules) -> DataFrame:
    """The undistorted stream as runs of their own."""
    return projected.join(F.broadcast(numbers(projected.sparkSession, rules)), "rule").withColumns({"arr": F.col("t"), "occ": F.col("t")})


def named(found: DataFrame, rules) -> DataFrame:
    """``found`` with the rule's name instead of the run of ``plain``."""
    return found.join(F.broadcast(numbers(found.sparkSession, rules)), "run").drop("run")


def baseline_subjects(projected: DataFrame, rules) -> DataFrame:
    """(rule, key)."""
    return named(detect.subjects(plain(projected, rules), [r.threshold for r in rules]), rules).select("rule", "key")


@dataclass(frozen=True)
class Sizes:
    """Measured once on the projected stream, as no run has more rows of a key: the width of time
    slices, and the keys that one task should not get."""

    width: int | None
    hot: DataFrame | None

    @staticmethod
    def of(stream: DataFrame) -> Sizes:
        return Sizes(width_of(stream, ["rule"], "t"), detect.hot_keys(stream.withColumn("occ", F.col("t")), "rule"))


def distorted(events: DataFrame, rules, fractions=FRACTIONS, multiples=MULTIPLES, seeds=SEEDS, structures=("random", "targeted", "delete"), clock: str = "M1", delay: str = "fixed", marked: Column | DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, projected stream, rows as the rules see them)."""
    runs = distort.grid(events.sparkSession, rules, fractions, multiples, seeds, structures)
    stream = cut(with_marks(project(events, rules), marked), "projected")
    if delay == "burst":
        rows = distort.burst(distort.spread(stream, runs))
    else:
        rows = distort.chosen(cut(distort.draws(stream, runs), "draws"), runs)
    return runs, stream, distort.arrive(rows, DELAYS[delay](*map(F.col, ("w", "multiple", "seed", "seq"))), clock)


def moving(events: DataFrame, rules, fractions=FRACTIONS, multiples=MULTIPLES, seeds=SEEDS, structures=("random", "targeted", "delete"), delay: str = "fixed", marked: Column | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the runs that exist, the projected stream with what they move): see ``compact``."""
    runs = distort.grid(events.sparkSession, rules, fractions, multiples, seeds, structures)
    if delay == "burst":
        rows, some = compact.moved_in_bursts(cut(with_marks(project(events, rules), marked), "projected"), runs, DELAYS[delay])
    else:
        stream = with_marks(project(events.withColumn("picks", compact.picks(seeds)), rules, "picks"), marked)
        rows, some = compact.moved(cut(stream, "projected"), runs, seeds, DELAYS[delay])
    return cut(some, "runs"), rows


def never_late(clock: str, delay: str):
    """Is nothing late in a run, whatever its rows are?"""
    if clock == "M2":
        return F.lit(True)
    deleting = F.col("structure") == "delete"
    return (deleting | (F.col("multiple") <= 1)) if delay in EVEN else deleting


@dataclass(frozen=True)
class Grid:
    """The runs that exist, and the projected stream with what they move: see ``compact``."""

    runs: DataFrame
    rows: DataFrame
    sizes: Sizes
    rules: tuple
    clock: str
    delay: str

    @staticmethod
    def of(events: DataFrame, rules, fractions=FRACTIONS, multiples=MULTIPLES, seeds=SEEDS, structures=("random", "targeted", "delete"), clock: str = "M1", delay: str = "fixed", marked: Column | DataFrame | None = None) -> Grid:
        if clock not in ("M1", "M2"):
            raise ValueError(f"unknown clock model {clock}")
        runs, rows = moving(events, rules, fractions, multiples, seeds, structures, delay, marked)
        return Grid(runs, rows, Sizes.of(rows), tuple(rules), clock, delay)

    def cells(self, buffers=None) -> dict[str, list[compact.Cell]]:
        """By rule: the undistorted stream as -1, -2, ... (see ``numbers``), and each run, or each run and buffer."""
        known, out = {r.name: r for r in self.rules}, {}
        for k, name in enumerate(sorted(known), 1):
            out[name] = [compact.Cell(-k, None, known[name].window, known[name].threshold)]
        for r in self.runs.collect():  # the caller's list
            rule, moving = known[r.rule], self.clock == "M1" and r.structure != "delete"
            for b, windows in enumerate([0.0] if buffers is None else buffers):
                cell = r.run if buffers is None else r.run * len(buffers) + b
                out[r.rule].append(compact.Cell(cell, r.run, rule.window, rule.threshold, int(windows * rule.window), moving, self.clock == "M2"))
        return out

    def evaluated(self, with_alerts: bool, buffers=None, only: str | None = None, listed: str = compact.DETECTED) -> DataFrame:
        """See ``compact.evaluated``; ``only`` is a condition on the rows that the rules get to see."""
        late = self.runs if buffers is not None else self.runs.where(~never_late(self.clock, self.delay))
        told = None if late.isEmpty() else compact.verdicts(self.rows, late, self.sizes.width, buffers is not None, None if only is None else F.expr(only), self.delay in EVEN)
        seen = self.rows if only is None else self.rows.where(only)
        return cut(compact.evaluated(seen, told, self.cells(buffers), with_alerts, self.sizes.hot, listed), "evaluated")


def sums(got: DataFrame) -> DataFrame:
    """(run, rows, dropped_late, max_delay, keys, known, alerts)."""
    all_ = [F.sum("rows").alias("rows"), F.sum("dropped").alias("dropped_late"), F.max("longest").alias("max_delay")]
    counts = [F.sum(c).alias(c) for c in ("keys", "known", "alerts")]
    return got.where("rows IS NOT NULL").groupBy(F.col("cell").alias("run")).agg(*all_, *counts)


def counted(got: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """A row per rule whose undistorted stream detects something (baseline_keys, baseline_alerts), and a row per run (or run and buffer)
    of ``sums``. What a run loses is what the baseline has and ``known`` lacks: keys are counted where they are evaluated, none are joined."""
    all_ = cut(sums(got), "sums")
    base = named(all_.where("run < 0"), rules).where("keys > 0")
    return base.select("rule", F.col("keys").alias("baseline_keys"), F.col("alerts").alias("baseline_alerts")), all_.where("run >= 0")


def detected(got: DataFrame) -> DataFrame:
    """(run, key, alerts) of the keys that are listed."""
    return got.where("key IS NOT NULL").select(F.col("cell").alias("run"), "key", "alerts")


def ordering_sweep(events: DataFrame, rules, clock: str = "M1", with_alerts: bool = True, delay: str = "fixed", **options) -> DataFrame:
    """A record per run: keys, losses, drops (and alerts with their reduction, null if the baseline
    has none)."""
    grid = Grid.of(events, rules, clock=clock, delay=delay, **options)
    base, found = counted(grid.evaluated(with_alerts, listed=compact.NONE), rules)
    out = grid.runs.join(found.drop("max_delay"), "run").join(base, "rule", "left").na.fill(0, ["baseline_keys"])
    out = out.withColumn("keys_lost", F.col("baseline_keys") - F.col("known")).drop("known")
    if with_alerts:
        lost = F.col("baseline_alerts") - F.col("alerts")
        out = out.na.fill(0, ["baseline_alerts"]).withColumns({"alerts_lost": lost, "alert_reduction": F.try_divide(lost, "baseline_alerts")})
    else:
        out = out.drop("alerts", "baseline_alerts")
    return out.withColumn("key_reduction", F.try_divide("keys_lost", "baseline_keys"))


def lost_subjects(events: DataFrame, rules, **options) -> DataFrame:
    """A row per run and baseline subject that the run does not detect: the run's columns and ``key``."""
    grid = Grid.of(events, rules, **options)
    return detected(grid.evaluated(False, listed=compact.LOST)).drop("alerts").join(F.broadcast(grid.runs), "run")


def targeting_sweep(events: DataFrame, rules, clock: str = "M1", delay: str = "fixed", **options) -> DataFrame:
    """A record per run: marked subjects that the baseline detects, and how many evade detection."""
    grid = Grid.of(events, rules, clock=clock, delay=delay, **options)
    base, found = counted(grid.evaluated(False, only="marked", listed=compact.NONE), rules)
    out = grid.runs.join(base.drop("baseline_alerts"), "rule").join(found.select("run", "known"), "run", "left").na.fill(0, ["known"])
    out = out.withColumnsRenamed({"baseline_keys": "malicious_detected"}).withColumn("malicious_evaded", F.col("malicious_detected") - F.col("known"))
    return out.drop("known").withColumn("evasion_rate", F.col("malicious_evaded") / F.col("malicious_detected"))


def mitigation_sweep(events: DataFrame, rules, buffers=(0.0, 0.5, 1.0, 2.0), delay: str = "fixed", **options) -> DataFrame:
    """A record per run and buffer size (in windows): drops, lost subjects and alerts that remain
    behind a reorder buffer; rules without baseline alerts are left out. All buffers are cells of one job."""
    options.setdefault("structures", ("random",))
    spark = events.sparkSession
    grid = Grid.of(events, rules, delay=delay, **options)
    size = spark.createDataFrame([(k, float(b)) for k, b in enumerate(buffers)], "size int, buffer_windows double")
    cells = grid.runs.withColumnRenamed("run", "of").join(F.broadcast(size)).withColumn("run", F.col("of") * len(buffers) + F.col("size"))
    base, found = counted(grid.evaluated(True, buffers, listed=compact.NONE), rules)
    res = cells.join(found.drop("keys"), "run").join(base, "rule").withColumn("keys_lost", F.col("baseline_keys") - F.col("known")).drop("known")
    lost, w = F.col("baseline_alerts") - F.col("alerts"), F.lit(None).cast("long")
    for r in rules:
        w = F.when(F.col("rule") == r.name, F.lit(r.window)).otherwise(w)
    size_us = (F.col("buffer_windows") * w).cast("long")
    return res.withColumns({"alerts_evaded": lost, "evasion_remaining": lost / F.col("baseline_alerts"), "buffer": size_us}).drop("of", "size")


def premise_check(events: DataFrame, w: int, n: int, scenarios=((0.05, 60), (0.05, 86_400), (0.2, 86_400), (0.2, 172_800), (0.5, 172_800)), seed: int = 0) -> DataFrame:
    """Each event of the whole stream delayed with a probability: drops and detected subjects of
    five (fraction, delay in seconds) scenarios against none."""
    spark = events.sparkSession
    grid = spark.createDataFrame([(k, float(f), int(d) * 1_000_000, seed) for k, (f, d) in enumerate([(0.0, 0), *scenarios])], "run int, fraction double, delay bigint, seed int")
    rows = events.select("seq", "t", "pid", F.col("pid").cast("string").alias("key"), F.lit(w).cast("long").alias("w"), F.lit(n).alias("n")).join(F.broadcast(grid))
    rows = distort.bernoulli(rows).withColumn("arr", F.col("t") + F.when(F.col("chosen"), F.col("delay")).otherwise(F.lit(0))).withColumn("occ", F.col("t"))
    return grid.join(detect.summary(cut(detect.mark_late(rows.select(*SEEN)), "marked"), [n], with_alerts=False), "run")
