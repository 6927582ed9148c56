"""Sinks that keep evidence: nothing is overwritten, and each result has a manifest beside it."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENGINE_VERSION = 1


def write_new(df: DataFrame, path: str, kind: str = "json", by: list[str] | None = None) -> None:
    """Write ``df``; an existing path is refused."""
    writer = df.write.mode("errorifexists").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


#: Session settings that say what code runs: a cluster's driver has no working tree to ask.
COMMIT, DIRTY = "spark.tidemark.commit", "spark.tidemark.dirty"


def provenance(spark: SparkSession) -> dict:
    """What made a result: this package's engine version, Spark's, the application, and the commit as
    the session's settings have it (null if they don't)."""
    asked = {name: spark.conf.get(key, None) for name, key in (("commit", COMMIT), ("dirty", DIRTY))}
    asked["dirty"] = None if asked["dirty"] is None else asked["dirty"].lower() == "true"
    return {"engine_version": ENGINE_VERSION, "spark_version": spark.version, "application": spark.sparkContext.applicationId, **asked}


def write_manifest(spark: SparkSession, path: str, schema: str, **facts) -> None:
    """One JSON record with the provenance and these facts (grid, counts, seconds), at ``path``.manifest."""
    record = json.dumps({"schema": schema, **provenance(spark), **facts})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.manifest").first()["value"])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run_shards(spark: SparkSession, path: str, shards: dict[str, Callable[[], DataFrame]], measures: dict[str, Column] | None = None, side_by_side: int = 4) -> dict:
    """Run each shard (name -> its records) that is not at ``path`` yet, and put it there in one step.

    A shard is written beside its place, with a manifest of what the writing job itself observed (rows,
    ``measures``, seconds), and renamed. So what is at ``path`` is whole, a call after a failure or a lost
    driver runs only what is missing, and no shard is overwritten. Shards run ``side_by_side``
    at a time in one session. Returns the sums over all shards; if some fail, the others are kept and an error names them."""
    fs, root = _hadoop(spark, path)
    fs.mkdirs(root)

    def one(name: str, make: Callable[[], DataFrame]) -> None:
        place, temp = f"{path}/shard={name}", f"{path}/_running-{name}-{uuid.uuid4().hex}"
        if fs.exists(_hadoop(spark, place)[1]):
            return
        seen, began = Observation(), time.time()
        rows = make().observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in (measures or {}).items()])
        try:
            rows.write.parquet(temp)
            facts = {"shard": name, "seconds": round(time.time() - began, 3), **seen.get}
            write_manifest(spark, f"{temp}/_shard", "shard", **facts)
            if not fs.rename(_hadoop(spark, temp)[1], _hadoop(spark, place)[1]):
                raise ValueError(f"shard {name} could not be put in its place")
        finally:
            if fs.exists(_hadoop(spark, temp)[1]):
                fs.delete(_hadoop(spark, temp)[1], True)

    failed = {}
    with ThreadPoolExecutor(side_by_side) as pool:
        jobs = {name: pool.submit(one, name, make) for name, make in shards.items()}
    for name, job in jobs.items():
        if job.exception() is not None:
            failed[name] = job.exception()
    if failed:
        name = sorted(failed)[0]
        raise RuntimeError(f"{len(failed)} of {len(shards)} shards failed: {sorted(failed)[:5]}") from failed[name]
    return shard_sums(spark, path, list(shards), list(measures or {}))


def shard_manifests(spark: SparkSession, path: str, names: list[str]) -> list[dict]:
    """The manifests of these shards; one that is missing is an error."""
    fs, _ = _hadoop(spark, path)
    missing = [n for n in names if not fs.exists(_hadoop(spark, f"{path}/shard={n}/_shard.manifest")[1])]
    if missing:
        raise ValueError(f"{len(missing)} shards are missing: {missing[:5]}")
    return [read_manifest(spark, f"{path}/shard={n}/_shard") for n in names]


def shard_sums(spark: SparkSession, path: str, names: list[str], measures: list[str]) -> dict:
    """Shards, rows, seconds and measures (sums) over all."""
    found = shard_manifests(spark, path, names)
    return {"shards": len(found), **{k: sum(m[k] or 0 for m in found) for k in ("rows", "seconds", *measures)}}


def read_shards(spark: SparkSession, path: str, names: list[str], order: list[str]) -> DataFrame:
    """The records of these shards in their order, then by ``order``; rows are counted against the
    manifests."""
    wanted = sum(m["rows"] for m in shard_manifests(spark, path, names))
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/shard={n}" for n in names])
    if (n := rows.count()) != wanted:
        raise ValueError(f"{n} records are there, {wanted} were written")
    places = spark.createDataFrame(list(zip(names, range(len(names)))), "shard string, _place int")
    return rows.withColumn("shard", F.col("shard").cast("string")).join(F.broadcast(places), "shard").orderBy("_place", *order).drop("_place", "shard")


def write_shards(records: DataFrame, path: str, by: list[str]) -> None:
    """One folder per shard, in one job; each shard is written by tasks of its own."""
    write_new(records.repartition(*by), path, "parquet", by)


def stitched(spark: SparkSession, path: str, by: list[str], expected: list[tuple], order: list[str]) -> DataFrame:
    """The shards' records in the order of ``expected`` (the catalogue's), then by ``order``. A shard
    that is missing is an error."""
    rows = spark.read.parquet(path)
    there = {tuple(r) for r in rows.select(*by).distinct().collect()}  # a row per shard
    if missing := [s for s in expected if tuple(s) not in there]:
        raise ValueError(f"{len(missing)} shards failed: {missing[:5]}")
    names = [f"{b} {dict(rows.dtypes)[b]}" for b in by]
    places = spark.createDataFrame([(*s, k) for k, s in enumerate(expected)], ", ".join([*names, "_place int"]))
    return rows.join(F.broadcast(places), by).orderBy("_place", *order).drop("_place")
