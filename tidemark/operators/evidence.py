"""Evidence lost under deletion: position masks, their application, and what they destroy."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.sampling import digest, ranked, word
from tidemark.operators.reorder import in_order

#: The tag that a mask's record bears.
MASK_TAG = "loss-mask-v2"
MASKS = "run int, rate string, pattern string, seed int, n bigint, k bigint"


def deletion_count(n: int, rate: str) -> int:
    """floor(n * rate) in exact decimals."""
    value = Decimal(rate) if not isinstance(rate, (bool, float)) else None
    if n < 0 or value is None or not value.is_finite() or not 0 <= value <= 1:
        raise ValueError("a rate is a decimal string from 0 to 1, and a count is not negative")
    return int(n * value)


def bounds(n: int, start: int = 0, end: int | None = None) -> tuple[int, int]:
    end = n if end is None else end
    if not 0 <= start < end <= n:
        raise ValueError("a selection is 0 <= start < end <= count")
    return start, end


def masks(spark: SparkSession, n: int, rates: list[str], seeds: list[int], patterns=("random", "contiguous")) -> DataFrame:
    rows = [(r, p, s, n, deletion_count(n, r)) for r in rates for p in patterns for s in seeds]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], MASKS)


def deleted(positions: DataFrame, mask: DataFrame, start: int = 0) -> DataFrame:
    """(run, pos): k positions drawn without replacement, or one run of k from a drawn start."""
    rows = positions.select("pos").join(F.broadcast(mask.where("pattern = 'random' AND k > 0")))  # a row per mask
    drawn = ranked(rows.withColumn("_h", digest("mask", F.col("seed"), F.col("pos"))), "run", "_h", "pos").where("rank <= k").select("run", "pos")
    begin = F.lit(start) + F.pmod(word(digest("mask", F.col("seed"), F.lit("start"))), F.col("n") - F.col("k") + 1)
    spans = mask.where("pattern = 'contiguous' AND k > 0").select("run", begin.alias("_b"), (begin + F.col("k")).alias("_e"))
    inside = positions.select("pos").join(F.broadcast(spans), (F.col("pos") >= F.col("_b")) & (F.col("pos") < F.col("_e"))).select("run", "pos")  # a row per mask
    return drawn.union(inside)


def apply_mask(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows that one mask retains, unchanged."""
    return rows.join(gone.select("pos"), "pos", "left_anti")


def measure(labelled: DataFrame, gone: DataFrame, mask: DataFrame) -> DataFrame:
    """Per mask: labelled events, processes and creations, and how much of each is destroyed. A
    process is silenced if all its events are gone; rates are null where there is nothing."""
    rows = labelled.select("pos", "pid", "is_create").join(F.broadcast(mask.select("run")))  # a row per mask
    hit = gone.withColumn("_gone", F.lit(1))
    rows = rows.join(hit, ["run", "pos"], "left").withColumn("gone", F.col("_gone").isNotNull())
    by_pid = rows.groupBy("run", "pid").agg(F.count("*").alias("n"), F.count_if("gone").alias("d"), F.count_if("is_create").alias("c"), F.count_if(F.col("is_create") & F.col("gone")).alias("cd"))
    known = F.col("pid").isNotNull()
    out = by_pid.groupBy("run").agg(
        F.sum("n").alias("events"), F.sum("d").alias("events_deleted"),
        F.count_if(known).alias("processes"), F.count_if(known & (F.col("n") == F.col("d"))).alias("silenced"),
        F.sum("c").alias("creates"), F.sum("cd").alias("creates_deleted"),
    )
    return out.withColumns({"event_rate": F.try_divide("events_deleted", "events"), "silenced_rate": F.try_divide("silenced", "processes"), "create_rate": F.try_divide("creates_deleted", "creates")})


def overlap(rows: DataFrame, gone: DataFrame, start: int, end: int) -> DataFrame:
    """Per mask: first and last deleted time, their distance, and how much of [start, end) is gone."""
    inside = (F.col("t") >= start) & (F.col("t") < end)
    total = rows.agg(F.count_if(inside).alias("window_events"))
    hit = rows.join(gone, "pos").groupBy("run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if(inside).alias("inside"))
    out = hit.join(F.broadcast(total))  # one row
    return out.withColumn("span_seconds", (F.col("last_t") - F.col("first_t")) / 1e6).withColumn("fraction", F.try_divide("inside", "window_events"))


def validate_mask(rows: DataFrame, start: int, end: int, facts: DataFrame | None = None) -> DataFrame:
    """(run, reason) of the masks that are refused. ``rows`` (run, place, pos) has a mask's positions in
    their order: they have to rise and to lie in the selection. With ``facts`` (run, schema, k,
    source_sha256, input_sha256) a mask also has to bear the right tag, to have been made from the
    input it is applied to, and to have as many positions as it says."""
    inside = (F.col("pos") >= start) & (F.col("pos") < end)
    size = rows.groupBy("run").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("inside"))
    rising = in_order(rows.select("run", F.col("place").alias("arr"), F.col("place").alias("seq"), F.col("pos").alias("occ")), strictly=True)
    all_ = size.join(rising, "run", "full_outer")
    reason = F.when(~F.col("ordered"), "not sorted and unique").when(~F.col("inside"), "outside the selection")
    if facts is not None:
        all_ = facts.join(all_, "run", "left")
        same = F.col("source_sha256") == F.col("input_sha256")
        reason = F.when(~F.coalesce(F.col("schema") == MASK_TAG, F.lit(False)), "another schema").when(~F.coalesce(same, F.lit(False)), "another input").when(F.coalesce("n", F.lit(0)) != F.col("k"), "another count").otherwise(reason)
    return all_.withColumn("reason", reason).where("reason IS NOT NULL").select("run", "reason")


def window_positions(rows: DataFrame, start: int, end: int, pure: bool = False) -> DataFrame:
    """One row: events, events in [start, end), adjacent decreases of time, and the positions of the
    window's first event and one past its last. rows: (pos, t, before), before the time of the
    preceding position."""
    inside = (F.col("t") >= start) & (F.col("t") < end)
    out = rows.agg(
        F.count("*").alias("events"), F.count_if(inside).alias("in_window"),
        F.count_if(F.col("t") < F.col("before")).alias("order_violations"),
        F.min(F.when(inside, F.col("pos"))).alias("selection_start"), (F.max(F.when(inside, F.col("pos"))) + 1).alias("selection_end"),
    )
    whole = F.coalesce(F.col("selection_end") - F.col("selection_start"), F.lit(0)) == F.col("in_window")
    return out.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("the window's positions hold events from outside")).cast("boolean"))) if pure else out


def score_nodes(scores: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """One row: labelled nodes, detected (strictly above the threshold), absent, alerts, precision
    (null without alerts). A node with two scores is an error."""
    twice = scores.groupBy("node").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a node has more than one score")
    alert = F.col("score") > threshold
    met = labels.select("node").distinct().join(scores, "node", "left").agg(F.count("*").alias("labelled"), F.count_if(alert).alias("detected"), F.count_if(F.col("score").isNull()).alias("absent"))
    all_ = scores.agg(F.count_if(alert).alias("alerted"))
    out = met.join(F.broadcast(all_))  # one row
    return out.withColumn("precision", F.try_divide("detected", "alerted")).withColumn("recall", F.try_divide("detected", "labelled"))
