"""Effects of event loss on a detector, from the records of its runs.

A record is one run: its case, its pattern of loss (``baseline`` for none), rate and seed, and how many
labelled nodes were detected. Failed runs are counted and left out of every average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that every record must have, and what they may hold.
FIELDS = {
    "run_id": "string", "case": "string", "host": "string", "pattern": "string", "requested_rate": "string", "seed": "bigint",
    "input_sha256": "string", "mask_sha256": "string", "selection_start": "bigint", "selection_end": "bigint", "deleted_count": "bigint",
    "detector_commit": "string", "checkpoint_sha256": "string", "threshold": "double", "case_detected": "boolean",
    "detected_label_nodes": "bigint", "total_label_nodes": "bigint", "started_at_utc": "string", "finished_at_utc": "string", "exit_status": "string",
}
NULLABLE = ("seed", "mask_sha256")
PATTERNS, STATUSES = ("baseline", "random", "contiguous"), ("completed", "failed")
PRIMARY_RATE, SEVERE = "0.10", 0.5


def rules() -> dict[str, Column]:
    """What a record must fulfil, by name."""
    c = F.col
    return {
        **{f"has {f}": c(f).isNotNull() for f in FIELDS if f not in NULLABLE},
        "known pattern": c("pattern").isin(*PATTERNS), "known status": c("exit_status").isin(*STATUSES), "labelled nodes": c("total_label_nodes") > 0,
        "detected among labelled": c("detected_label_nodes").between(F.lit(0), c("total_label_nodes")),
        "case detected": c("case_detected") == (c("detected_label_nodes") > 0), "seed unless baseline": (c("pattern") == "baseline") == c("seed").isNull(),
    }


def read_json(lines: DataFrame) -> DataFrame:
    """``lines`` (value: one JSON record a row) as records. A missing field, or a value of another kind
    (a boolean is no number, a number no string), is an error."""
    kinds = {"string": "STRING", "bigint": "BIGINT", "double": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN"}
    record, out, bad = F.parse_json("value"), [], []
    for field, sql in FIELDS.items():
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{field}", "variant"))
        good = kind.rlike(f"^({kinds[sql]}{'|VOID' if field in NULLABLE else ''})$")
        bad.append(F.when(kind.isNull(), F.lit(f"{field} is missing")).when(~good, F.lit(f"{field} is no {sql}")))
        out.append(F.try_variant_get(record, f"$.{field}", sql).alias(field))
    lines = lines.where("trim(value) <> ''")
    refuse(lines, F.coalesce(*bad))
    return lines.select(*out)


def refuse(rows: DataFrame, reason: Column) -> None:
    """An error if a row has a reason. Asked at once: inside a plan, the optimiser may put such a
    check before the filters that it relies on."""
    found = rows.agg(F.min(reason)).first()[0]
    if found:
        raise ValueError(f"run record: {found}")


def checked(records: DataFrame) -> DataFrame:
    """``records``; one that breaks a rule is an error."""
    refuse(records, F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules().items()]))
    return records


def completed(records: DataFrame) -> DataFrame:
    return records.where("exit_status = 'completed'").withColumn("recall", F.col("detected_label_nodes") / F.col("total_label_nodes"))


def baselines(records: DataFrame) -> DataFrame:
    """(case, baseline_detected, baseline_recall); a case with two of them is an error."""
    base = completed(records).where("pattern = 'baseline'").groupBy("case").agg(F.count("*").alias("_n"), F.first("case_detected").alias("baseline_detected"), F.first("recall").alias("baseline_recall"))
    refuse(base, F.when(F.col("_n") > 1, F.concat(F.lit("more than one baseline of "), "case")))
    return base.drop("_n")


def arms(records: DataFrame) -> DataFrame:
    """A row per case, rate and pattern: seeds, detected runs, R (share of runs that detect the case),
    RC (mean recall) with its extremes, range and deviation, and runs below half the baseline's recall."""
    runs = completed(records).where("pattern <> 'baseline'").join(baselines(records), "case", "left")
    severe = F.col("recall") < F.col("baseline_recall") * SEVERE
    r = F.col("recall")
    return runs.groupBy("case", "requested_rate", "pattern").agg(
        F.count("*").alias("seeds"), F.count_if("case_detected").alias("detected_runs"), F.avg(F.col("case_detected").cast("double")).alias("R"), F.avg(r).alias("RC"),
        F.min(r).alias("RC_min"), F.max(r).alias("RC_max"), (F.max(r) - F.min(r)).alias("RC_range"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("RC_stdev"),
        F.count_if(severe).alias("severe_seeds"), F.avg(severe.cast("double")).alias("severe_seed_fraction"),
    )


EFFECTS = ["EV", "EV_ratio", "E_severe", "L_random", "L_contiguous", "E", "LC_random", "LC_contiguous", "EC"]


def effects(records: DataFrame) -> DataFrame:
    """A row per case and rate that has both arms: effects of loss on means (E, L, EC, LC) and on
    spread (EV), null with a reason where the baseline detects nothing."""
    known = arms(records)
    side = lambda p: known.where(F.col("pattern") == p).select("case", "requested_rate", *[F.col(c).alias(f"{p}_{c}") for c in ("R", "RC", "RC_stdev", "severe_seed_fraction")])
    rows = side("random").join(side("contiguous"), ["case", "requested_rate"]).join(baselines(records), "case", "left")
    c, base = F.col, F.col("baseline_recall")
    ok = F.coalesce(c("baseline_detected"), F.lit(False))
    values = {
        "EV": c("contiguous_RC_stdev") - c("random_RC_stdev"), "EV_ratio": F.try_divide("contiguous_RC_stdev", "random_RC_stdev"),
        "E_severe": c("contiguous_severe_seed_fraction") - c("random_severe_seed_fraction"), "L_random": 1 - c("random_R"), "L_contiguous": 1 - c("contiguous_R"),
        "E": c("random_R") - c("contiguous_R"), "LC_random": base - c("random_RC"), "LC_contiguous": base - c("contiguous_RC"), "EC": c("random_RC") - c("contiguous_RC"),
    }
    reason = F.when(~ok, "no baseline detection; loss effect is not defined")
    return rows.select("case", "requested_rate", "baseline_detected", "baseline_recall", "random_R", "contiguous_R", *[F.when(ok, v).alias(k) for k, v in values.items()], reason.alias("excluded_reason"))


def overall(records: DataFrame, rate: str = PRIMARY_RATE) -> DataFrame:
    """One row: cases with effects at the primary rate and their means. Where every run of both arms
    detects its case, detection is saturated and recall is what a conclusion rests on."""
    rows = effects(records).where((F.col("requested_rate") == rate) & F.col("excluded_reason").isNull())
    full = F.coalesce(F.bool_and((F.col("random_R") == 1) & (F.col("contiguous_R") == 1)), F.lit(False))
    out = rows.agg(F.count("*").alias("evaluable_cases"), *[F.avg(x).alias(f"mean_{x}") for x in ("E", "EC", "EV", "E_severe")], full.alias("saturated"))
    return out.withColumn("metric", F.when(F.col("saturated"), "frozen_label_node_recall").otherwise("case_detection_rate"))
