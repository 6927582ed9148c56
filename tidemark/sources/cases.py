"""Cases: named event logs with an evaluation window, and the rule projections made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rules import Rule, project


def subset(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """The rows with an allowed value; an empty list allows all."""
    return df.where(F.col(column).isin(*allowed)) if allowed else df


class CaseSource:
    """Projections by case, from ``load`` (case -> events) or, with ``cache``, from Parquet that is
    written once per case. A case asked for again is not planned anew."""

    def __init__(self, spark: SparkSession, load: Callable[[str], DataFrame], rules: tuple[Rule, ...], cache: str | None = None):
        self.spark, self.load, self.rules, self.cache = spark, load, tuple(rules), cache
        self._case: str | None = None
        self._rows: DataFrame | None = None

    def path(self, case: str) -> str:
        return f"{self.cache}/case={case}"

    def fill(self, case: str) -> None:
        """Write a case's projections; what is there is never overwritten. What was written is read
        back and compared."""
        rows = project(self.load(case), self.rules)
        rows.write.mode("errorifexists").partitionBy("rule").parquet(self.path(case))
        facts = lambda df: sorted(map(tuple, df.groupBy("rule").agg(F.count("*"), F.sum(F.xxhash64("seq", "t", "key", "pid").cast("decimal(20,0)"))).collect()))
        if facts(rows) != facts(self.spark.read.parquet(self.path(case))):
            raise ValueError(f"the cache of {case} differs from its projection")

    def get(self, case: str) -> DataFrame:
        if case != self._case:
            self._rows = project(self.load(case), self.rules) if self.cache is None else self.spark.read.parquet(self.path(case))
            self._case = case
        return self._rows
