"""Ranked lexical search: the best documents for each item, by integer scores.

Postings (term, document, occurrences, terms of the document) are a table bucketed by term and
sorted. A term that many documents hold is bucketed by document instead, so no bucket gets a hot
term whole, and all hot terms of one document meet in one bucket. Items' terms join the postings,
each match is scored in 64-bit integers, scores are summed by item and document, and a window
ranks each item's documents. The hot terms of a document are summed in one task before the shuffle,
which moves one row for each of them together, and every task cuts to its own best k before the last one.

Only terms that items hold get postings. Items are taken in blocks of at most BLOCK_TERMS terms
(an item is never split), so what is sent to all tasks is bounded; each block reads the documents anew.

Defined results: a null text has no terms and no score; an item without terms has no rows; rows
that repeat an item's id are one item with the terms of all; rows that repeat a document's id are
ranked one by one; of equal scores a null id comes first; empty tables yield no rows; other columns
are never read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, cut, kept, released, scratch_path
from tidemark.llm.fingerprint import words

#: Documents that an item gets.
TOP = 50
#: Terms of the items that are looked up in one pass over the documents.
BLOCK_TERMS = 200_000
#: A term is hot if this share of the documents holds it: a document of n distinct terms bounds
#: how many there can be.
HOT_SHARE = 0.02
#: Postings of a bucket, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 24
#: Bytes of a text whose words are listed at a time.
STEP = 4_000_000
#: ASCII letters lower-cased and digits stay, other ASCII parts words, all other bytes stay.
_KEEP = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    raw, start = (text or "").encode().translate(_KEEP), 0
    while start < len(raw):
        end = start + STEP
        if end < len(raw):  # between two terms: the last space before, else the next one
            before = raw.rfind(b" ", start + 1, end)
            end = before if before > 0 else raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def numbered_terms(shared) -> dict[bytes, int]:
    return kept("search", shared, lambda: {t: k for k, t in enumerate(shared.value)})


def statistics(docs: DataFrame, shared, text_col: str) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term; documents with a term; terms in all."""
    size = len(shared.value)

    def run(batches):
        number = numbered_terms(shared)
        df, docs_, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                held, n = set(), 0
                for part in term_lists(text.as_py()):
                    n += len(part)
                    held.update(part)
                df[[number[t] for t in held if t in number]] += 1
                docs_ += n > 0
                terms += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [docs_, terms]]))], names=["term", "n"])

    counts = docs.select(col(text_col)).mapInArrow(lambda b: released(run(b)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(counts["term"], counts["n"]))
    df = np.array([found.get(k, 0) for k in range(size)], np.int64)
    return df, int(found.get(-1, 0)), int(found.get(-2, 0))


def postings(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(term, row, doc_id, tf, n): of each document the terms that are asked for."""
    def run(batches):
        number, names = numbered_terms(shared), pa.array([t.decode() for t in shared.value], pa.string())
        for batch in batches:
            ids, rows, terms, tfs, ns, sizes = batch.column(0), batch.column(1), [], [], [], []
            for text in batch.column(2):
                seen, n = Counter(), 0
                for part in term_lists(text.as_py()):
                    n += len(part)
                    seen.update(part)
                own = [(number[t], c) for t, c in seen.items() if t in number]
                terms += [t for t, _ in own]
                tfs += [c for _, c in own]
                ns += [n] * len(own)
                sizes.append(len(own))
            term, at = np.array(terms, np.int64), np.repeat(np.arange(batch.num_rows), sizes)
            order = np.argsort(term, kind="stable")  # neighbours share a term: less to shuffle
            at = pa.array(at[order])
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(term[order])), rows.take(at), ids.take(at), pa.array(np.array(tfs, np.int64)[order]), pa.array(np.array(ns, np.int64)[order])], names=["term", "row", "doc_id", "tf", "n"]
            )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), col(text_col))
    return rows.mapInArrow(lambda b: released(run(b)), "term string, row bigint, doc_id bigint, tf bigint, n bigint")


def term_bucketed(found: DataFrame, terms: DataFrame, buckets: int) -> DataFrame:
    """The postings as a table: terms (term, hot) of many documents bucketed by document."""
    spark, name = found.sparkSession, f"postings_{uuid.uuid4().hex}"
    placed = found.join(F.broadcast(terms.select("term", "hot")), "term")
    placed = placed.withColumn("slot", F.when(F.col("hot"), F.col("row")).otherwise(F.xxhash64("term"))).repartition(buckets, "slot")
    placed.write.bucketBy(buckets, "slot").sortBy("term", "row").option("path", scratch_path(spark, "postings")).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved: the files outlive the entry in the catalogue
    spark.sql(f"DROP TABLE {name}")
    return out


def match_score(w: Column, tf: Column, n: Column, docs: int, terms: int) -> Column:
    """In 64-bit integers throughout."""
    names = {"w": w, "tf": tf, "n": n, "docs": F.lit(docs).cast("long"), "terms": F.lit(max(terms, 1)).cast("long")}
    div = lambda a, b: F.call_function("div", a, b)
    m = F.lit(50).cast("long") + div(F.lit(50).cast("long") * names["n"] * names["docs"], names["terms"])
    return w * div(F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(20).cast("long") * m)


def ranked(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of (item_id, term)."""
    spark = docs.sparkSession
    names = sorted(r.term for r in wanted.select("term").distinct().collect())  # bounded by BLOCK_TERMS
    shared = spark.sparkContext.broadcast([t.encode() for t in names])
    df, n_docs, n_terms = statistics(docs, shared, text_col)
    terms = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string()), "df": pa.array(df), "hot": pa.array(df > n_docs * HOT_SHARE)}))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    asked = F.broadcast(wanted.join(terms, "term").select("item_id", "term", weight.alias("w")))
    buckets = max(LEAST_BUCKETS, math.ceil(int(df.sum()) / BUCKET_ROWS))
    table = term_bucketed(postings(docs, shared, id_col, text_col), terms, buckets)
    score = match_score(F.col("w"), F.col("tf"), F.col("n"), n_docs, n_terms)
    found = table.join(asked, "term").select("item_id", "row", "doc_id", score.alias("score"))
    summed = found.groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, top: int = TOP, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` documents of each item."""
    wanted = cut(items.select(col(item_col).alias("item_id"), F.explode(words(col(item_text))).alias("term")).distinct(), "wanted")
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    out = None
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        part = ranked(own, docs, id_col, text_col, top)
        out = part if out is None else out.union(part)
    return out


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM d, g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
