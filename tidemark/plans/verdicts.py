"""Verdicts on hypotheses, drawn from the records of sweeps.

Each returns its cells with ``holds``, and with every cell the share of cells that hold and whether
the hypothesis is ``adopted``. Cells are few: a row per rule, fraction, multiple and buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats

#: Delays beyond which, and up to which, a verdict is asked for, in windows.
BEYOND, HIDDEN, VISIBLE = (2.0, 5.0, 10.0), (0.5, 0.75, 0.9, 1.0), 2.0
FRACTION = 0.2
#: A difference of two arms is small inside this margin; cells with fewer marked subjects are secondary.
MARGIN, PRIMARY = 0.05, 5


def judged(cells: DataFrame, adopted, among: Column | None = None) -> DataFrame:
    """``cells`` with ``share`` of those ``among`` that hold, and ``adopted`` of (share, holding, all)."""
    among = F.lit(True) if among is None else among
    all_ = cells.agg(F.count_if(among).alias("_n"), F.count_if(among & F.col("holds")).alias("_h"))
    share = F.try_divide("_h", "_n")
    out = cells.join(F.broadcast(all_))  # one row
    return out.withColumn("share", share).withColumn("adopted", F.coalesce(adopted(share, F.col("_h"), F.col("_n")), F.lit(False))).drop("_n", "_h")


def mean(records: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.avg(value).alias(name))


def beyond_is_delete(records: DataFrame, value: str = "alert_reduction") -> DataFrame:
    """Does a delay beyond the window do what deleting does, to within 0.01, in 9 of 10 cells?"""
    late = records.where((F.col("structure") == "random") & F.col("multiple").isin(*BEYOND))
    gone = mean(records.where("structure = 'delete'"), value, "gone", "rule", "fraction")
    cells = mean(late, value, "late", "rule", "fraction", "multiple").join(gone, ["rule", "fraction"])
    cells = cells.withColumn("difference", F.col("late") - F.col("gone")).withColumn("holds", F.abs("difference") <= 0.01)
    return judged(cells, lambda share, held, n: share >= 0.9)


def hidden_maxima(records: DataFrame, value: str = "alert_reduction") -> DataFrame:
    """(rule, hidden): the largest mean loss at delays that drop nothing."""
    few = records.where((F.col("structure") == "random") & (F.col("fraction") == FRACTION) & F.col("multiple").isin(*HIDDEN))
    return mean(few, value, "m", "rule", "multiple").groupBy("rule").agg(F.max("m").alias("hidden"))


def hidden_below_visible(records: DataFrame, value: str = "alert_reduction") -> DataFrame:
    """Is the largest loss without drops below the loss at two windows, in 13 of 15 units?"""
    at = records.where((F.col("structure") == "random") & (F.col("fraction") == FRACTION) & (F.col("multiple") == VISIBLE))
    cells = hidden_maxima(records, value).join(mean(at, value, "visible", "rule"), "rule").withColumn("holds", F.col("hidden") < F.col("visible"))
    return judged(cells, lambda share, held, n: held * 15 >= n * 13)


def largest_without_drops(records: DataFrame, value: str = "alert_reduction") -> DataFrame:
    """The cell without drops that loses most; of equals the last one."""
    cells = records.where("structure = 'random'").groupBy("rule", "fraction", "multiple").agg(F.avg(value).alias("m"), F.sum("dropped_late").alias("_d"))
    top = cells.where("_d = 0 AND m IS NOT NULL").agg(F.max(F.struct("m", "rule", "fraction", "multiple")).alias("t"))
    return top.select("t.rule", "t.fraction", "t.multiple", F.col("t.m").alias("reduction"))


def rank_of_clocks(records: DataFrame, arrivals: DataFrame, immune: tuple[str, ...], value: str = "alert_reduction") -> DataFrame:
    """One row: the rank correlation between what a rule loses to ten windows of delay where it sees
    arrivals and to hidden delays where it sees occurrences (below .5?), and whether rules thought
    immune lose .02 or more to those in 4 of 6 units."""
    far = arrivals.where((F.col("structure") == "random") & (F.col("fraction") == FRACTION) & (F.col("multiple") == 10.0))
    both = mean(far, value, "far", "rule").join(hidden_maxima(records, value), "rule")
    rho = stats.spearman(both.withColumn("all", F.lit(1)), ["all"], "far", "hidden").select("n", "rho")
    own = both.where(F.col("rule").isin(*immune)).agg(F.count("*").alias("immune"), F.count_if(F.col("hidden") >= 0.02).alias("hits"))
    out = rho.join(F.broadcast(own))  # one row each
    return out.withColumn("rank_adopted", F.coalesce(F.col("rho") < 0.5, F.lit(False))).withColumn("hits_adopted", F.col("hits") * 6 >= F.col("immune") * 4)


def targeting_equivalence(records: DataFrame, resamples: int = stats.RESAMPLES) -> DataFrame:
    """Are targeted and random delay equivalent: 90 % interval of the difference inside the margin,
    in 7 of 10 primary cells, and no primary cell whose 95 % interval lies above it?"""
    keys = ["rule", "fraction", "multiple"]
    cells = stats.bootstrap_difference(records.where("multiple IS NOT NULL"), keys, "structure", "targeted", "random", "evasion_rate", "seed", resamples)
    size = records.groupBy(*keys).agg(F.max("malicious_detected").alias("malicious_detected"))
    primary = F.col("malicious_detected") >= PRIMARY
    cells = cells.join(size, keys).withColumn("holds", (F.col("p05") >= -MARGIN) & (F.col("p95") <= MARGIN)).withColumn("primary", primary)
    cells = cells.withColumn("direction", F.when(F.col("p025") > 0, "targeted").when(F.col("p975") < 0, "random"))
    cells = cells.withColumn("beyond", F.col("p025") > MARGIN)
    worst = cells.agg(F.count_if(F.col("primary") & F.col("beyond")).alias("_b"))
    out = judged(cells.join(F.broadcast(worst)), lambda share, held, n: (share >= 0.7) & (F.col("_b") == 0), F.col("primary"))
    return out.drop("_b")


def buffer_cells(records: DataFrame) -> DataFrame:
    return mean(records, "evasion_remaining", "remaining", "rule", "fraction", "multiple", "buffer_windows")


def staircase(records: DataFrame) -> DataFrame:
    """With spread delays, does a buffer of the mean delay leave between a tenth and nine tenths of
    what no buffer leaves (where that is .02 or more), in 3 of 4 cells?"""
    cells, keys = buffer_cells(records), ["rule", "fraction", "multiple"]
    none = cells.where("buffer_windows = 0 AND remaining >= 0.02").select(*keys, F.col("remaining").alias("r0"))
    full = cells.where("buffer_windows = multiple").select(*keys, F.col("remaining").alias("rd"))
    both = none.join(full, keys).withColumn("holds", (F.col("rd") > 0.1 * F.col("r0")) & (F.col("rd") < 0.9 * F.col("r0")))
    return judged(both, lambda share, held, n: share >= 0.75)


def partial_buffer(records: DataFrame) -> DataFrame:
    """Does no buffer leave more than none does, by over 0.01?"""
    cells, keys = buffer_cells(records), ["rule", "fraction", "multiple"]
    none = cells.where("buffer_windows = 0").select(*keys, F.col("remaining").alias("r0"))
    both = cells.where("buffer_windows <> 0").join(none, keys).withColumn("difference", F.col("remaining") - F.col("r0"))
    return judged(both.withColumn("holds", F.col("difference") <= 0.01), lambda share, held, n: held == n)


def full_buffer_harmless(records: DataFrame) -> DataFrame:
    """One row: runs, those with a buffer of the longest delay, and such that still lose alerts."""
    full = F.col("buffer") >= F.col("max_delay")
    return records.agg(F.count("*").alias("runs"), F.count_if(full).alias("full"), F.count_if(full & (F.col("alerts_evaded") != 0)).alias("violations"))
