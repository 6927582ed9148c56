"""Threshold rules: N events that share a key within any W seconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALL = ("signup", "error", "click", "view", "purchase")


@dataclass(frozen=True)
class Rule:
    name: str
    object: str
    action: str | tuple[str, ...]
    key: str
    window_seconds: int
    threshold: int

    def __post_init__(self):
        if self.threshold < 1 or self.window_seconds <= 0:
            raise ValueError("a rule needs a threshold of 1 or more and a window above 0")

    @property
    def actions(self) -> tuple[str, ...]:
        return (self.action,) if isinstance(self.action, str) else tuple(self.action)

    @property
    def window(self) -> int:
        return self.window_seconds * 1_000_000


#: For the ``events`` table.
CATALOGUE = (
    Rule("dense_any", "EVENT", ALL, "pid", 86_400, 5),
    Rule("mid_cp", "EVENT", ("click", "purchase"), "pid", 172_800, 4),
    Rule("sparse_err", "EVENT", "error", "pid", 259_200, 4),
    Rule("near_thr", "EVENT", ALL, "pid", 86_400, 6),
    Rule("prop_key", "EVENT", ALL, "k", 43_200, 5),
)


def pid_rules(rules=CATALOGUE) -> tuple[Rule, ...]:
    """The rules whose subjects are processes: only those can be targeted."""
    return tuple(r for r in rules if r.key == "pid")


def catalogue(spark: SparkSession, rules=CATALOGUE) -> DataFrame:
    """(rule, object, action, key_name, w, n): one row per rule and action."""
    rows = [(r.name, r.object, a, r.key, r.window, r.threshold) for r in rules for a in r.actions]
    return spark.createDataFrame(rows, "rule string, object string, action string, key_name string, w bigint, n int")


def project(events: DataFrame, rules=CATALOGUE, *more: str) -> DataFrame:
    """(rule, seq, t, key, pid, w, n) and ``more`` of the events that a rule looks at; a null key is no subject.
    The catalogue is a short list of this module's caller, so it is broadcast."""
    rows = events.join(F.broadcast(catalogue(events.sparkSession, rules)), ["object", "action"])
    key = F.when(F.col("key_name") == "pid", F.col("pid").cast("string")).otherwise(F.col("properties")[F.col("key_name")])
    return rows.select("rule", "seq", "t", key.alias("key"), "pid", "w", "n", *more).where("key IS NOT NULL")


def malicious(pid="pid", every: int = 7):
    """The marked subjects of the ``events`` table."""
    return F.col(pid) % every == 0


def with_marks(rows: DataFrame, marked: Column | DataFrame | None = None, pid: str = "pid") -> DataFrame:
    """``rows`` with ``marked``: a condition, or whether the first column of a DataFrame has the pid; none
    means those of the ``events`` table. A null pid is not marked."""
    if isinstance(marked, DataFrame):
        found = marked.select(F.col(marked.columns[0]).alias("_marked")).distinct()
        return rows.join(found, F.col(pid) == F.col("_marked"), "left").withColumn("marked", F.col("_marked").isNotNull()).drop("_marked")
    return rows.withColumn("marked", F.coalesce(malicious(pid) if marked is None else marked, F.lit(False)))
