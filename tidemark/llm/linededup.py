"""Line deduplication by overlapping three-line windows.

Each run of three consecutive lines is hashed. A window that occurs more than once keeps its first
occurrence, in the order of document id and position; the lines of later occurrences are removed,
overlapping ones merged. Where a later occurrence overlaps the first in the same document (a line
repeated many times), the first one's three lines stay. Windows of blank lines don't count.

Defined results: a null text stays null and has no lines; a text of fewer than three lines is left
alone; rows that repeat id and text whole are one document and get equal results; a null id comes
before any other; an empty table yields no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm._scratch import col, cut, fresh, kept, released


def windows(text: Column, span: int) -> Column:
    """The hash of each window of ``span`` lines, null where all its lines are blank."""
    lines = F.split(text, "\n", -1)
    hashed = F.transform(lines, lambda x: F.unhex(F.md5(x.cast("binary"))))
    full = F.transform(lines, lambda x: (F.trim(x) != "").cast("int"))
    joined, some = hashed, full
    for k in range(1, span):
        joined = F.zip_with(joined, F.slice(hashed, k + 1, F.size(hashed)), lambda a, b: F.concat(a, b))
        some = F.zip_with(some, F.slice(full, k + 1, F.size(full)), lambda a, b: F.greatest(a, b))
    return F.zip_with(joined, some, lambda h, s: F.when(s > 0, F.unhex(F.md5(h))))


def left_of(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The text without the lines start..end (from 0, inclusive) of each interval."""
    def one(t, first, last):
        if t is None or first is None:
            return t
        lines = t.split("\n")
        dead = bytearray(len(lines))
        for a, b in zip(first, last):
            dead[a : b + 1] = b"\1" * (b + 1 - a)
        return "\n".join(x for x, d in zip(lines, dead) if not d)

    return pd.Series([one(*x) for x in zip(text, starts, ends)], dtype=object)


@F.pandas_udf(StringType())
def without_lines(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    kept("lines", None, dict)
    yield from released(left_of(*x) for x in columns)


def repeated_spans(keyed: DataFrame, span: int) -> DataFrame:
    """(d, h, starts, ends) of the documents that lose lines; keyed: (d, h, t)."""
    at = F.posexplode(windows(F.col("t"), span)).alias("pos", "w")
    seen = cut(keyed.select("d", "h", at).where("w IS NOT NULL"), "windows")
    first = seen.groupBy("w").agg(F.min(F.struct("d", "h", "pos")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("w", F.col("f.d").alias("fd"), F.col("f.h").alias("fh"), F.col("f.pos").alias("fp")), "first")
    # both sides come from tables, so that the join's hot windows can be split
    same = F.col("d").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh"))
    start = F.when(same, F.greatest(F.col("pos"), F.col("fp") + span)).otherwise(F.col("pos"))
    later = seen.join(first, "w").where(~(same & (F.col("pos") == F.col("fp")))).select("d", "h", start.alias("a"), (F.col("pos") + span - 1).alias("b"))
    return later.where("a <= b").groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s")).select("d", "h", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``."""
    d, h, starts, ends = fresh(docs, "_d", "_h", "_starts", "_ends")
    text_hash = F.xxhash64(col(text_col))
    spans = repeated_spans(docs.select(col(id_col).alias("d"), text_hash.alias("h"), col(text_col).alias("t")), span)
    spans = spans.toDF(d, h, starts, ends)
    rows = docs.join(spans, col(id_col).eqNullSafe(col(d)) & (text_hash == col(h)), "left")
    # all columns of one name twice are addressed through their frame
    kept = [without_lines(col(text_col), col(starts), col(ends)).alias(text_col) if c == text_col else col(c) for c in docs.columns]
    return rows.select(*kept)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, lines before, lines removed, and the text that is left."""
    lines = lambda c: F.when(col(c).isNull(), 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1)
    rows = docs.select("doc_id", "text", lines("text").cast("long").alias("n_lines"), F.col("text").alias("before"))
    left = line_dedup(rows)
    removed = F.when(F.col("text").eqNullSafe(F.col("before")), 0).when(F.col("text") == "", F.col("n_lines")).otherwise(F.col("n_lines") - lines("text"))
    return left.select("doc_id", "n_lines", removed.cast("long").alias("n_removed"), "text")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 0))) AS pos FROM l),
w AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w FROM e
      WHERE trim(lines[pos + 1]) <> '' OR trim(lines[pos + 2]) <> '' OR trim(lines[pos + 3]) <> ''),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp
      FROM w WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
r AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS p
      FROM f WHERE NOT (doc_id = fd AND pos = fp)),
g AS (SELECT doc_id, list(p) AS dead FROM r GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(dead), 0) AS BIGINT) AS n_removed,
       CASE WHEN dead IS NULL THEN text
            ELSE coalesce(array_to_string([x FOR x, i IN lines IF NOT list_contains(dead, i - 1)], chr(10)), '') END AS text
FROM l LEFT JOIN g USING (doc_id)
"""
