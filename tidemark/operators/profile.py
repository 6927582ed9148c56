"""What JSON records hold: every path at any depth, with the kinds of its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut


def kind_of(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    sql = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "VOID": "null"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), sql)


def json_values(records: DataFrame, json_col: str) -> DataFrame:
    """(row, path, kind) of every value of every record: ``$`` is the record, ``.key`` a member, ``[*]``
    any element of an array. A level of depth is a round over what the level above holds, so there are
    as many rounds as records are deep. A text that is no JSON fails; null has no values."""
    top = records.select(F.monotonically_increasing_id().alias("row"), F.lit("$").alias("path"), F.parse_json(F.col(json_col)).alias("value")).where("value IS NOT NULL")
    level, out = cut(top, "level"), None
    while True:
        own = level.select("row", "path", kind_of(F.col("value")).alias("kind"))
        out = own if out is None else out.union(own)
        inside = level.where(kind_of(F.col("value")).isin("object", "array")).withColumnRenamed("value", "outer")
        inside = inside.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("outer").outer()))
        step = F.when(F.col("key").isNull(), F.lit("[*]")).otherwise(F.concat(F.lit("."), "key"))
        level = cut(inside.select("row", F.concat("path", step).alias("path"), "value"), "level")
        if level.isEmpty():
            return out


def profile(records: DataFrame, json_col: str, limit: int | None = None) -> DataFrame:
    """(path, kind, n, in_rows, in_every_row): values of this kind at this path, the records that have
    one, and whether every record has the path (with a value of any kind). ``limit`` takes that many records."""
    records = records.select(json_col) if limit is None else records.select(json_col).limit(limit)
    found = cut(json_values(records, json_col), "values")
    total = found.where("path = '$'").count()
    whole = found.groupBy("path").agg((F.countDistinct("row") == total).alias("in_every_row"))
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"), F.countDistinct("row").alias("in_rows")).join(whole, "path")
