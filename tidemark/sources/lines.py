"""Text files by line position.

A position is a line's place in its file, from 0, blank lines counted. Files are read as Spark splits
them: a pass over the splits counts their lines, and a line's position is that of its split plus its place
in it. A gzip file is one split. Only one row a split is gathered, by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut

BLANK = ("refuse", "skip", "keep")


def line_positions(spark: SparkSession, path: str | list[str], blank: str = "refuse", across: bool = False) -> DataFrame:
    """(file, pos, value) of the lines of one or several files or folders, plain or gzip, that end in LF or CRLF.
    Lines of white space alone are refused with an error, skipped (their positions are left out) or kept. With
    ``across``, positions go on from file to file in the order of their names."""
    if blank not in BLANK:
        raise ValueError(f"blank lines are to {', '.join(BLANK)}")
    text = spark.read.option("lineSep", "\n").text(path)
    split = ["file", "_start"]
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("value"),
    )
    rows = cut(rows, "lines")  # a split's rows keep their numbers from here on
    sizes = rows.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if across:
        files = sizes.groupBy("file").agg(F.sum("_n").alias("_n"))
        ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
        starts = starts.join(files.select("file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_files")), "file").withColumn("_before", F.col("_before") + F.col("_files")).drop("_files")
    found = rows.join(starts, split).select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "value")
    empty = F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) == ""
    if blank == "skip":
        return found.where(~empty)
    if blank == "refuse":
        said = F.concat(F.lit("blank line "), F.col("pos").cast("string"), F.lit(" of "), F.col("file"))
        return found.where(F.when(empty, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return found
