"""Integrity checks of artefacts and records."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.archive import opened
from tidemark.sources.scratch import cut


def text_hash(text: Column) -> Column:
    """SHA-256 with line ends normalised to LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


#: Files up to this size are hashed from Spark's own reader, larger ones in blocks as they are read.
WHOLE, PIECE = 64 << 20, 1 << 20


def hash_in_pieces(path: str, piece: int = PIECE) -> str:
    """SHA-256 of a file of any size, in the memory of one piece."""
    state = hashlib.sha256()
    with opened(path) as file:
        while data := file.read(piece):
            state.update(data)
    return state.hexdigest()


def file_hashes(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """(path, size, sha256) of whole files of any size, in folders of any depth, side by side. Small
    ones come through Spark's reader, so any store that it knows will do; larger ones through pyarrow. Files
    without a byte are not listed by that reader and left out."""
    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hash_in_pieces(p) for p in paths], pa.string())], names=["path", "size", "sha256"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = found.where(F.col("length") > whole).select("path", F.col("length").alias("size")).repartition("path")
    return small.union(large.mapInArrow(run, "path string, size bigint, sha256 string"))


def verify_pins(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, status): ok, mismatch or missing, for every pinned (name, sha256)."""
    status = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("f.sha256") == F.col("p.sha256"), "ok").otherwise("mismatch")
    return pinned.alias("p").join(found.alias("f"), F.col("p.name") == F.col("f.name"), "left").select(F.col("p.name").alias("name"), status.alias("status"))


def next_offset(offset: Column, size: Column) -> Column:
    """Where the member after this one begins in a tar archive."""
    return offset + 512 + F.ceil(size / 512) * 512


def violations(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many records break each rule; null counts as broken."""
    one = records.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return one.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "n"))


def compare(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(mismatches, only_old, only_new): records by key, fields compared null-safely."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.withColumn("_a", F.lit(1)).alias("a").join(b.withColumn("_b", F.lit(1)).alias("b"), on, "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count_if(here & differs).alias("mismatches"), F.count_if(F.col("_b").isNull()).alias("only_old"), F.count_if(F.col("_a").isNull()).alias("only_new"))


def stored_members(spark: SparkSession, headers: DataFrame, schema) -> DataFrame:
    """(path, sha256, events) of stored files of JSON lines, read back whole, from (path, size) as their
    archive's headers have them. One that is missing or of another size, that is cut off, or that has a line
    which does not parse, is an error."""
    paths = [r.path for r in headers.select("path").distinct().collect()]  # the caller's list of files
    found = cut(file_hashes(spark, paths), "hashes")
    wrong = headers.alias("h").join(found.alias("f"), "path", "left").where(~F.col("h.size").eqNullSafe(F.col("f.size")))
    if not wrong.isEmpty():
        raise ValueError("the stored size is not the header's")
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("events"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    counted = lines.withColumn("path", plain("path"))
    return found.withColumn("path", plain("path")).join(counted, "path", "left").select("path", "sha256", F.coalesce("events", F.lit(0)).alias("events"))


def stored_member(spark: SparkSession, path: str, size: int, schema) -> DataFrame:
    """(sha256, events) of one stored file: see ``stored_members``."""
    headers = spark.read.format("binaryFile").load(path).select("path", F.lit(size).cast("long").alias("size"))
    return stored_members(spark, headers, schema).select("sha256", "events")


def variants(index: DataFrame, name: str, facts: list[str]) -> DataFrame:
    """(name, variants, verdict) of the entries of an index: how many different ones bear each name. Equal
    entries count once; a name with several is a conflict."""
    return index.groupBy(name).agg(F.countDistinct(*facts).alias("variants")).withColumn("verdict", F.when(F.col("variants") == 1, "one").otherwise("conflict"))


def select_member(index: DataFrame, suffix: str) -> DataFrame:
    """The one member (name, file_id, data_offset, size) of an index whose name ends so. Equal
    entries count once; different ones, or none, are an error."""
    own = index.where(F.col("name").endswith(suffix)).select("name", "file_id", "data_offset", "size").distinct()
    found = variants(own.withColumn("_suffix", F.lit(suffix)), "_suffix", ["name", "file_id", "data_offset", "size"]).first()
    if found is None or found["verdict"] != "one":
        raise ValueError(f"one indexed member was expected, {'none' if found is None else 'several'} found")
    return own


def same_facts(a: DataFrame, b: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """The rows of ``a`` whose artefact in ``b`` (by ``keys``) agrees in all ``facts`` (input hash,
    selection, case); one that is missing or disagrees is an error when it is read."""
    other = b.select(*keys, *[F.col(f).alias(f"_{f}") for f in facts], F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), F.lit("an artefact is missing"))
    for f in facts:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f"artefacts differ in {f}"))
    good = F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean"))
    return a.join(other, keys, "left").where(good).select(*a.columns)
