"""Event sources: provenance JSON lines, and the ``events`` table in the same shape.

Time is BIGINT microseconds everywhere: comparisons at a deadline are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import cut

_S = T.StringType()
#: One provenance event per line; ``timestamp`` is ISO-8601 with an offset.
EVENT = T.StructType(
    [T.StructField(n, _S) for n in ("id", "hostname", "object", "action", "objectID", "actorID")]
    + [T.StructField(n, T.LongType()) for n in ("pid", "ppid", "tid")]
    + [T.StructField("principal", _S), T.StructField("properties", T.MapType(_S, _S)), T.StructField("timestamp", _S)]
)

HAS_OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


def micros(timestamp: Column) -> Column:
    """Microseconds of an ISO-8601 string; digits beyond six are cut off. A string without an
    offset has no defined instant and raises."""
    return F.when(timestamp.rlike(HAS_OFFSET), F.unix_micros(timestamp.cast("timestamp"))).when(timestamp.isNotNull(), F.raise_error(F.concat(F.lit("timestamp without an offset: "), timestamp)).cast("long"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzip; a line that does not parse fails the read."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path).withColumn("t", micros(F.col("timestamp")))


def read_records(spark: SparkSession, path: str, schema: T.StructType, tag: str | None = None) -> DataFrame:
    """JSON-line records; blank lines are skipped, and with ``tag`` every record must bear it."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if tag is None:
        return rows
    return rows.where(F.when(F.col("schema").eqNullSafe(tag), F.lit(True)).otherwise(F.raise_error(F.lit(f"a record is not {tag}")).cast("boolean")))


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as (seq, t, pid, object, action, properties, value)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("user_id").alias("pid"),
        F.lit("EVENT").alias("object"),
        F.col("event_type").alias("action"),
        F.from_json("props", "map<string,string>").alias("properties"),
        "value",
    )


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its 0-based place in this order. Partitions are ranges of the order;
    only their sizes reach the driver, so no task ever holds the whole table."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows, "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted(rows.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if not starts:
        return rows.select(*df.columns, F.lit(0).cast("long").alias("pos"))
    first = df.sparkSession.createDataFrame(starts, "_p bigint, _first bigint")
    out = rows.join(F.broadcast(first), part == F.col("_p"))  # a row per partition
    return out.select(*df.columns, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))
