"""Event logs laid out by time: files whose ranges of time are known and do not meet, so that a window
reads few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lay_out(events: DataFrame, path: str, time: str = "t", files: int | None = None) -> None:
    """Write a log sorted by time, and beside it the range of each file; what is there is refused."""
    dealt = events.repartitionByRange(files, time) if files else events.repartitionByRange(time)
    dealt.sortWithinPartitions(time).write.mode("errorifexists").parquet(f"{path}/rows")
    rows = events.sparkSession.read.parquet(f"{path}/rows")
    ranges = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count("*").alias("n"))
    ranges.coalesce(1).write.mode("errorifexists").parquet(f"{path}/ranges")  # a row a file


def files_of(spark: SparkSession, path: str, start: int, end: int) -> list[str]:
    """The files that may hold events of [start, end)."""
    ranges = spark.read.parquet(f"{path}/ranges")
    return sorted(r.file for r in ranges.where((F.col("hi") >= start) & (F.col("lo") < end)).select("file").collect())


def read_window(spark: SparkSession, path: str, start: int, end: int, time: str = "t", checked: bool = True) -> DataFrame:
    """Events with start <= time < end, from the files that may hold them. With ``checked``, times that
    fall within a file, or files whose ranges meet, are an error: there the window might be wrong."""
    files = files_of(spark, path, start, end)
    if not files:
        return spark.read.parquet(f"{path}/rows").where("false")
    rows = spark.read.parquet(*files)
    if checked:
        check_order(spark, path, rows, time)
    return rows.where((F.col(time) >= start) & (F.col(time) < end))


def check_order(spark: SparkSession, path: str, rows: DataFrame, time: str = "t") -> None:
    """An error where these rows of the log are not in order of time."""
    ranges = spark.read.parquet(f"{path}/ranges")
    before = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    if not ranges.withColumn("_before", before).where(F.col("lo") < F.col("_before")).isEmpty():
        raise ValueError(f"{path}: files whose ranges of time meet")
    own = Window.partitionBy("_file").orderBy("_at")
    numbered = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), time)
    broken = numbered.withColumn("_last", F.lag(time).over(own)).where(F.col(time) < F.col("_last")).select("_file").first()
    if broken is not None:
        raise ValueError(f"{broken[0]}: not in order of time")
