"""Document fingerprints: bottom-k sketches of word shingles, with DataFrame functions only.

A text's words are its runs of letters and digits (and of all characters beyond ASCII), A-Z
lower-cased; its shingles are the runs of five words. A sketch is the sorted list of the K smallest
64-bit digests of distinct shingles, as hexadecimal strings. Sketches of parts merge to the sketch of the whole,
and two sketches tell how much their sets share, how much of one is in the other and how many
distinct shingles each has; sets of fewer than K shingles are told exactly.

Defined results: a null text counts as empty; an empty text has an empty sketch, and two empty ones
are alike (1.0); a text of one to four words is one shingle; a text of none (but not empty) is its own
shingle; rows of equal ids follow each other by text; a null id comes after all others; an empty
table yields no rows; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._scratch import ascii_lower, col

K, WORDS = 128, 5
#: What stands between words: ASCII that is neither letter nor digit.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a slice of neighbouring ids, which is sorted in memory, and the most slices there are:
#: their bounds travel with the plan.
SLICE_ROWS, MAX_SLICES = 2_000, 20_000
NO_ID = -(1 << 63)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), "")


def digest(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def shingle_digests(text: Column, span: int = WORDS) -> Column:
    """The digest of each shingle, in the order of the text."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - span), lambda i: digest(F.concat_ws(" ", *[F.get(w, i + k) for k in range(span)])))
        return F.when(F.size(w) >= span, runs).when(F.size(w) > 0, F.array(digest(F.concat_ws(" ", w)))).when(text != "", F.array(digest(text))).otherwise(F.array().cast("array<string>"))

    return let(words(text), of)


def least(digests: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(digests)), 1, k)


def sketch(text: Column, k: int = K, span: int = WORDS) -> Column:
    text = F.coalesce(text, F.lit(""))
    return least(shingle_digests(text, span), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union of two sets that both have."""
    both = F.array_intersect(a, b)
    return let(merge(a, b, k), lambda m: F.when(F.size(m) == 0, 1.0).otherwise(F.size(F.array_intersect(m, both)) / F.size(m)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second has too; null where the first is so much
    smaller that none of its digests is among the k least of both."""
    own = let(merge(a, b, k), lambda m: F.array_intersect(m, a))
    share = let(own, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = F.conv(F.substring(F.element_at(a, k), 1, 13), 16, 10).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1.0) * float(1 << 52)) / (last + 1.0))


def as_text(a: Column) -> Column:
    return F.array_join(a, "")


def merged(rows: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each value of ``keys``. Each task cuts its own rows to the k least of a key
    before the shuffle, so a hot key sends k rows a task, not all of its documents."""
    each = rows.select(*[col(c) for c in keys], F.explode(col(sketch_col)).alias("digest")).distinct()
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("digest"))
    few = each.withColumn("at", at).where(F.col("at") <= k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("digest")).alias(sketch_col))


def bounds_of(rows: DataFrame, key: str) -> list[int]:
    """Ids, largest first, at which the slices begin; each is an id that occurs."""
    n, top = rows.agg(F.count("*"), F.max(key)).first()
    if not n:
        return [0]
    parts = max(math.ceil(n / SLICE_ROWS), min(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 50)))
    parts = min(parts, MAX_SLICES)
    inner = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(key, inner, 10 * max(parts, 1000))).first()[0] if inner else []
    return sorted({top, *cuts}, reverse=True)


def slice_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds after the first are not below the key: looked up in two steps."""
    step = math.isqrt(len(bounds) - 1) + 1
    table = F.lit(np.array(bounds, np.int64))
    coarse = F.size(F.filter(F.lit(np.array(bounds[::step], np.int64)), lambda b: b >= key)) - 1
    return let(coarse, lambda i: i * step + F.size(F.filter(F.slice(table, i * step + 1, step), lambda b: b >= key)) - 1)


def with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """(slice, ghost, id, key, text) so that each row's successor by descending id stands behind it in
    its slice: the first rows of a slice are there twice, once as ghosts at the end of the slice before (the
    first of all at the end of the last). One shuffle brings each text to its place."""
    rows = rows.withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    bounds = bounds_of(rows.select("key"), "key")
    at = rows.withColumn("own", slice_of(F.col("key"), bounds))
    first = F.get(F.lit(np.array(bounds, np.int64)), F.col("own")) == F.col("key")
    place = lambda s, ghost: F.struct(s.alias("slice"), F.lit(ghost).alias("ghost"))
    before = F.when(F.col("own") == 0, len(bounds) - 1).otherwise(F.col("own") - 1)
    places = F.when(first, F.array(place(F.col("own"), False), place(before, True))).otherwise(F.array(place(F.col("own"), False)))
    placed = at.select("id", "key", "text", F.inline(places))
    return placed, Window.partitionBy("slice").orderBy("ghost", F.desc("key"), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, span: int = WORDS) -> DataFrame:
    """Of each row: its fingerprint and that of its text whose last half is replaced by the first
    characters of the next row's (by descending id, in a circle), and what the sketches tell."""
    rows = docs.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    placed, order = with_next(rows)
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(next_text, half)"))
    made = placed.select("*", F.lead("text").over(order).alias("next_text"), n_chars.alias("n_chars"), half.alias("half"))
    made = made.select("slice", "ghost", "key", "id", "text", "n_chars", F.coalesce(edited, F.col("text")).alias("edited"))
    made = made.select("slice", "ghost", "key", "id", "text", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text"), k, span).alias("own"), sketch(F.col("edited"), k, span).alias("other"))
    made = made.withColumn("next", F.lead("own").over(order)).where(~F.col("ghost"))
    own, other, after = F.col("own"), F.col("other"), F.col("next")
    return made.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"),
        containment(own, other, k).alias("in_edited"), distinct_shingles(own, k).alias("n_shingles"),
    )


def source_fingerprints(docs: DataFrame, key: str = "source", text_col: str = "text", k: int = K) -> DataFrame:
    """The sketch of all texts of each source, merged from those of its documents."""
    own = docs.select(col(key).alias(key), sketch(col(text_col), k).alias("sketch"))
    return merged(own, [key], "sketch", k).select(key, as_text(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate({{t}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}')"
_SKETCH = f"""list_sort(list_distinct(CASE WHEN len({{w}}) >= {WORDS} THEN [substr(md5(array_to_string({{w}}[i : i + {WORDS - 1}], ' ')), 1, 16) FOR i IN range(1, len({{w}}) - {WORDS - 2})]
    WHEN len({{w}}) > 0 THEN [substr(md5(array_to_string({{w}}, ' ')), 1, 16)] WHEN {{t}} <> '' THEN [substr(md5({{t}}), 1, 16)] ELSE CAST([] AS VARCHAR[]) END))[1:{K}]"""


def _sketch_sql(t: str, w: str) -> str:
    return _SKETCH.format(t=t, w=w)


_LIKE = f"CASE WHEN len({{m}}) = 0 THEN 1.0 ELSE CAST(len(list_filter({{m}}, lambda x: list_contains({{a}}, x) AND list_contains({{b}}, x))) AS DOUBLE) / len({{m}}) END"
_COUNT = f"CASE WHEN len({{a}}) < {K} THEN CAST(len({{a}}) AS DOUBLE) ELSE CAST({(K - 1) << 52} AS DOUBLE) / (CAST(CAST('0x' || substr({{a}}[{K}], 1, 13) AS BIGINT) AS DOUBLE) + 1.0) END"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nt
           FROM documents WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substring(t, 1, n - n // 2) || substring(nt, 1, n // 2) AS et FROM d),
w AS (SELECT *, {_WORDS.format(t='t')} AS w, {_WORDS.format(t='et')} AS ew FROM e),
s AS (SELECT doc_id, n, et, {_sketch_sql('t', 'w')} AS a, {_sketch_sql('et', 'ew')} AS b FROM w),
x AS (SELECT *, coalesce(lead(a) OVER o, first_value(a) OVER o) AS c FROM s WINDOW o AS (ORDER BY doc_id DESC)),
m AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:{K}] AS ab, list_sort(list_distinct(list_concat(a, c)))[1:{K}] AS ac FROM x),
p AS (SELECT *, list_filter(ab, lambda x: list_contains(a, x)) AS own FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       {_LIKE.format(m='ab', a='a', b='b')} AS near_edited, {_LIKE.format(m='ac', a='a', b='c')} AS near_next,
       CASE WHEN len(a) = 0 THEN 1.0 WHEN len(own) > 0 THEN CAST(len(list_filter(own, lambda x: list_contains(b, x))) AS DOUBLE) / len(own) END AS in_edited,
       {_COUNT.format(a='a')} AS n_shingles
FROM p
"""
SOURCES_SQL = f"""
WITH w AS (SELECT source, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT source, unnest({_sketch_sql('t', 'w')}) AS h FROM w),
r AS (SELECT source, list_sort(list_distinct(list(h)))[1:{K}] AS a FROM s GROUP BY source)
SELECT source, array_to_string(a, '') AS fingerprint, {_COUNT.format(a='a')} AS n_shingles FROM r
"""
