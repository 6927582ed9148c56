"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text (A-Z lower-cased).
A batch of documents is reduced to one row per digest, sort-merge anti-joined with the index, and
what is new is appended. Only DataFrame functions are used.

Defined results: a null text counts as empty; rows with a null id lose against any id; of rows
repeated whole, one stays; a digest that the index has keeps the id it came with, so a later batch with a
larger id keeps the older (``exact_dedup`` adds larger ids first); an empty table yields no rows; other
columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._scratch import ascii_lower, col, cut, scratch_path

#: A digest is hot if it holds more than this share of all rows: there are fewer than
#: 1 / HOT_SHARE such digests at any size, which bounds what is broadcast.
HOT_SHARE = 1 / 1000
#: Rows of documents for each bucket of a new index, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 32


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row_id) of each row, written once: row_id tells repeated rows apart."""
    sha = F.unhex(F.sha2(ascii_lower(col(text_col)).cast("binary"), 256))
    return cut(docs.select(col(id_col).alias("doc_id"), sha.alias("digest"), F.monotonically_increasing_id().alias("row_id")), "digests")


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest, kept at ``path`` between sessions.
    Each ``add`` appends a sorted file to each bucket; ``compacted`` writes an index whose buckets
    have one file, so that joins need no sort."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` that the index lacks, each with the largest id."""
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.name)

    def compacted(self, name: str, path: str, buckets: int | None = None) -> DigestIndex:
        """The same digests as a new index, with as many buckets as the table has outgrown."""
        out = DigestIndex(self.spark, name, path, buckets or self.buckets)
        self.table().repartition(out.buckets, "digest").write.insertInto(name)
        return out

    def drop(self) -> None:
        """Take the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def resolve(self, batch: DataFrame) -> DataFrame:
        """One row per row of ``batch``: the id that stays, the size of its group, and whether
        this row is the one that stays. Hot digests meet their group in a broadcast join of
        bounded size, the others in a sort-merge join, so no task gets a whole hot group."""
        sizes = batch.groupBy("digest").agg(
            F.count("*").alias("group_size"),
            F.max(F.struct(F.col("doc_id"), F.col("row_id"))).alias("top"),
        )
        known = self.table().join(sizes.hint("merge"), "digest")
        groups = cut(known.select("digest", "keep_id", "group_size", "top.row_id", F.col("top.doc_id").alias("top_id")).withColumnRenamed("row_id", "top_row"), "groups")
        hot = groups.where(F.col("group_size") > batch.count() * HOT_SHARE)
        mass = batch.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest")
        rows = mass.unionByName(batch.join(F.broadcast(hot), "digest"))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("top_id").eqNullSafe(F.col("keep_id")) & (F.col("row_id") == F.col("top_row"))
        return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fill a new index with ``docs`` in two batches, larger ids first, and resolve all rows. The
    number of buckets follows the number of rows unless given."""
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    buckets = buckets or max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"), buckets)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    index.add(rows.where(upper))
    index.add(rows.where(~upper))
    out = index.resolve(rows)  # it reads what resolve() wrote, not the index
    index.drop()
    return out


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
