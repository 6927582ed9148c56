"""Group statistics of run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import digest, uniform
from tidemark.functions.slicing import SLICE_ROWS, running, width_of
from tidemark.sources.scratch import cut

RESAMPLES = 10_000


def summary(x: str) -> list[Column]:
    """n, mean, sample deviation (0 for one value) and extremes; nulls are left out."""
    v = F.col(x)
    sd = F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range")]


def ranked_values(df: DataFrame, keys: list[str], x: str, most: int = SLICE_ROWS, count: Column | None = None) -> DataFrame:
    """(keys, x, c, before) of the distinct values of each group: how many rows have it (or another
    ``count``), and how many a smaller one. Values are counted first, and large groups are summed in slices of the value."""
    values = cut(df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg((F.count("*") if count is None else count).alias("c")), "values")
    summed = running(values, keys, [x], x, F.sum, "c", "before", width_of(values, keys, x, most))
    return summed.select(*keys, x, "c", F.coalesce("before", F.lit(0)).alias("before"))


def _at_places(values: DataFrame, keys: list[str], x: str, places: dict[str, Column], more: list[Column]) -> DataFrame:
    """Per group n, ``more`` and the value at each place (from 0, a column of ``n``) of the sorted rows."""
    sizes = values.groupBy(*keys).agg(F.sum("c").alias("n"), *more)
    here = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("c"))
    picks = [F.max(F.when(here(place), F.col(x))).alias(name) for name, place in places.items()]
    return sizes.join(values.join(sizes.select(*keys, "n"), keys).groupBy(*keys).agg(*picks), keys)


def index_quantiles(df: DataFrame, keys: list[str], x: str, quantiles: dict[str, float], most: int = SLICE_ROWS, count: Column | None = None) -> DataFrame:
    """The value at place floor(q * (n - 1)) of each group's sorted values, per named quantile; ``count`` as in ``ranked_values``."""
    values = ranked_values(df, keys, x, most, count)
    more = [F.coalesce(F.sum(F.when(F.col(x) == 0, F.col("c"))), F.lit(0)).alias("zeros"), F.min(x).alias("least"), F.max(x).alias("most")]
    out = _at_places(values, keys, x, {k: F.floor(F.lit(q) * (F.col("n") - 1)) for k, q in quantiles.items()}, more)
    return out.select(*keys, "n", "zeros", "least", *quantiles, "most")


def quantiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float], most: int = SLICE_ROWS) -> DataFrame:
    """(keys, n, quantiles), interpolated between the two values that a quantile lies between."""
    values = ranked_values(df, keys, x, most)
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    places = {f"_{e}_{k}": (F.floor if e == "lo" else F.ceil)(place(q)) for k, q in wanted.items() for e in ("lo", "hi")}
    out = _at_places(values, keys, x, places, [])
    between = [(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (place(q) - F.floor(place(q)))).alias(k) for k, q in wanted.items()]
    return out.select(*keys, "n", *between)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, most: int = SLICE_ROWS) -> DataFrame:
    """(keys, n, rho): rank correlation with average ranks; null where a side has no spread. Pairs are
    counted first, ranks come from counts of values, and the rest is sums."""
    pairs = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_n")), "pairs")
    ranks = {}
    for side, c in (("_x", x), ("_y", y)):
        values = ranked_values(pairs, keys, c, most, F.sum("_n"))
        ranks[side] = values.select(*keys, F.col(c).alias(f"_v{side}"), (F.col("before") + (F.col("c") + 1) / 2.0).alias(side))
    rows = pairs
    for side, c in (("_x", x), ("_y", y)):
        rows = rows.withColumn(f"_v{side}", F.col(c)).join(ranks[side], [*keys, f"_v{side}"])
    sizes = pairs.groupBy(*keys).agg(F.sum("_n").alias("n"))
    rows = rows.join(sizes, keys)
    middle = (F.col("n") + 1) / 2.0
    a, b, n = F.col("_x") - middle, F.col("_y") - middle, F.col("_n")
    sums = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"))
    spread = (F.col("_aa") > 0) & (F.col("_bb") > 0)
    return sums.select(*keys, "n", F.when(spread, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"))


def bootstrap_difference(df: DataFrame, keys: list[str], arm: str, first: str, second: str, x: str, by: str = "seed", resamples: int = RESAMPLES) -> DataFrame:
    """Percentiles .025, .05, .95 and .975 of the difference of the two arms' means, both resampled;
    null where an arm is empty. A cell is a handful of runs, in the order of ``by``. Each draw is a
    digest of cell, arm, resample and place, so the draws repeat anywhere, and the resamples of all
    cells are spread over all tasks."""
    side = lambda name: F.transform(F.sort_array(F.collect_list(F.when((F.col(arm) == name) & F.col(x).isNotNull(), F.struct(by, x)))), lambda s: s[x])
    cells = df.groupBy(*keys).agg(side(first).alias("_a"), side(second).alias("_b")).withColumn("_cell", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    tasks = max(1, df.sparkSession.sparkContext.defaultParallelism)

    def mean(values: str, name: str) -> Column:
        n = F.size(values)
        drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(F.col(values), F.floor(uniform(digest("boot", F.col("_cell"), F.lit(name), F.col("_r"), j)) * n).cast("int")))
        return F.aggregate(drawn, F.lit(0.0), lambda s, v: s + v) / n

    full = cells.where((F.size("_a") > 0) & (F.size("_b") > 0))
    blocks = full.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "_cell", "_block")
    draws = blocks.withColumn("_r", F.explode(F.sequence(F.col("_block"), F.lit(resamples - 1), F.lit(tasks)))) if resamples >= tasks else full.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    found = draws.select("_cell", (mean("_a", first) - mean("_b", second)).alias("_d")).groupBy("_cell").agg(F.percentile("_d", [0.025, 0.05, 0.95, 0.975]).alias("_p"))
    plain = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0))
    out = cells.join(found, "_cell", "left")
    return out.select(*keys, (plain("_a") - plain("_b")).alias("difference"), *[F.get("_p", k).alias(n) for k, n in enumerate(("p025", "p05", "p95", "p975"))])


def first_maximum(df: DataFrame, keys: list[str], by: str, x: str) -> DataFrame:
    """Where ``x`` is largest over the ordered ``by`` (the first of equals), and whether that is
    inside the range of ``by`` or at its upper end."""
    order = F.struct(F.col(x), -F.col(by))
    out = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.max(order).alias("_top"), F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    at = -F.col("_top.col2")
    return out.select(*keys, at.alias("peak_at"), F.col(f"_top.{x}").alias("peak"), ((at > F.col("_lo")) & (at < F.col("_hi"))).alias("interior"), (at == F.col("_hi")).alias("at_largest"))
