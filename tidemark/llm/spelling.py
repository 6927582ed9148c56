"""Spelling variants: words of a corpus at edit distance one, by a trie self-join.

The vocabulary is a trie whose subtrees are dealt out by prefix: a subtree is cut off where it holds
no more than CUT_WORDS words, so that no task gets a large one. In each task, active nodes are
propagated down level by level: the nodes at distance one of a node's children follow from those of
the node and from its own children, all nodes of a level at once. A node whose active node is at distance one
already can only go on by the same character in both, so across subtrees (where the edit lies above the
cut) an active pair is decided by what follows being equal: there words meet in groups of those that
agree but for one place of the prefix, which are no more than the letters that may stand there.

A word's form is its most frequent near word if that is at least ten times as frequent; its root is
reached by following forms, found by pointer doubling.

Defined results: a null text has no words; a null id counts as an empty string in the checksum that
decides which run loses a code point; rows that repeat id and text count each; words of fewer than
seven code points, or seen once, are left out; an empty table yields no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import LOWER, UPPER, col, cut, kept, released

LEAST_CHARS, LEAST_SEEN, DAMAGE, TIMES = 7, 2, 31, 10
#: Words of a subtree in one task, the first depth at which subtrees are cut, and words that are walked at a time.
CUT_WORDS, CUT_DEPTH, WALK_WORDS = 20_000, 3, 60_000
#: Words that a task counts before it passes them on.
COUNTED = 400_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = str.maketrans(UPPER, LOWER)
#: No code point of a word, so that it can stand for the place of an edit.
PLACE = " "


def damaged(word: str, doc_id: str) -> str:
    """The word, or the word without one code point if the checksum says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(word, n) of all words of that length that occur so often; counted in each task first."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    runs, name = Counter(m for m in RUN.findall(text.as_py()) if len(m) >= least_chars), doc_id.as_py()
                    for found, n in low(runs):
                        word = damaged(found, name)
                        if len(word) >= least_chars:
                            total[word] += n
                if len(total) > COUNTED:
                    yield table(total)
                    total = Counter()
        if total:
            yield table(total)

    def low(runs: Counter):
        out: Counter = Counter()
        for m, n in runs.items():
            out[m.translate(_LOW)] += n
        return out.items()

    def table(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def watched(batches):
        kept("spelling", None, dict)
        yield from released(run(batches))

    rows = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")), col(text_col))
    counted = rows.mapInArrow(watched, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_seen)


def subtrees(words: DataFrame, most: int = CUT_WORDS, depth: int = CUT_DEPTH) -> DataFrame:
    """``words`` with the depth at which each word's subtree is cut off: the least of ``depth``, twice
    that and so on at which no more than ``most`` words share the prefix, or the word's length."""
    left, done = words, None
    while True:
        sizes = left.groupBy(F.left("word", F.lit(depth)).alias("prefix")).agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > most).select("prefix")
        large = cut(large, "large")
        last = large.isEmpty()
        own = left if last else left.join(large, F.left("word", F.lit(depth)) == F.col("prefix"), "left_anti")
        own = own.withColumn("depth", F.least(F.lit(depth), F.length("word")))
        done = own if done is None else done.unionByName(own)
        if last:
            return done
        left = left.join(large, F.left("word", F.lit(depth)) == F.col("prefix"), "left_semi")
        depth *= 2


class Words:
    """Words of several subtrees, sorted by subtree and code points, as one array of code points."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.group = group


def near_pairs(words: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words of one group at distance one, both ways; words are sorted by group and
    code points and distinct.

    A node is a run of words with a common beginning. ``same`` has active pairs of one level (one
    replaced code point), ``longer`` pairs of a node and one a level deeper (one more code point in it)."""
    w = Words(words, group)
    n = len(words)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    lo, hi = starts, np.append(starts[1:], n)
    none = np.zeros(0, np.int64)
    same, level = (none, none), 0
    kids = children(w, lo, hi, level)
    fresh = np.flatnonzero((hi - lo)[kids[3]] > 1)
    longer = kids[3][fresh], fresh
    xs, ys = [], []
    while len(lo):
        c_lo, c_hi, c_char, c_parent, first, count = kids
        # the next level's own nodes and their children
        grand = children(w, c_lo, c_hi, level + 1)
        # siblings: one code point replaced here; and pairs of before that go on alike
        p, q = siblings(first, count)
        a, b = matched(*same, kids, kids)
        new_same = np.concatenate([p, a]), np.concatenate([q, b])
        # a node and its child: one code point more; and pairs of before (a at this level, b one deeper)
        a, b = matched(*longer, kids, grand)
        own = grand[3][b] == a  # a child of its own: among the fresh ones
        fresh = np.flatnonzero((c_hi - c_lo)[grand[3]] > 1)  # a node of one word has no other below it
        a, b = np.concatenate([grand[3][fresh], a[~own]]), np.concatenate([fresh, b[~own]])
        level += 1
        lo, hi, kids = c_lo, c_hi, grand
        ends = w.size[lo] == level  # the shortest word of a node stands first
        deep_lo = grand[0]
        deep_ends = w.size[deep_lo] == level + 1 if len(deep_lo) else np.zeros(0, bool)
        both = ends[new_same[0]] & ends[new_same[1]]
        xs.append(lo[new_same[0][both]])
        ys.append(lo[new_same[1][both]])
        both = ends[a] & deep_ends[b]
        xs.append(lo[a[both]])
        ys.append(deep_lo[b[both]])
        same, longer = new_same, (a, b)
        # what can still lead to a pair: nodes of several words, and active pairs
        live = (hi - lo) > 1
        live[same[0]] = live[same[1]] = live[longer[0]] = True
        live[grand[3][longer[1]]] = True
        if not live.all():
            lo, hi, kids, same, longer = pruned(live, lo, hi, kids, same, longer)
    x, y = np.concatenate([none, *xs]), np.concatenate([none, *ys])
    return np.concatenate([x, y]), np.concatenate([y, x])


def children(w: Words, lo: np.ndarray, hi: np.ndarray, level: int):
    """Children of the nodes lo..hi of a level: (lo, hi, character, parent), sorted by parent and
    character, and each parent's first child and number of children."""
    size = hi - lo
    words = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    parent = np.repeat(np.arange(len(lo)), size)
    on = w.size[words] > level
    words, parent = words[on], parent[on]
    char = w.chars[w.start[words] + level]
    new = np.ones(len(words), bool)
    if len(words):
        new[1:] = (parent[1:] != parent[:-1]) | (char[1:] != char[:-1])
    at = np.flatnonzero(new)
    c_lo, c_hi = words[at], words[np.append(at[1:], len(words)) - 1] + 1 if len(at) else words[at]
    c_parent = parent[at]
    count = np.bincount(c_parent, minlength=len(lo))
    return c_lo, c_hi, char[at], c_parent, np.cumsum(count) - count, count


def siblings(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each two children of a node."""
    k = np.repeat(count, count)  # for each child its node's number of children
    place = np.arange(len(k)) - np.repeat(first, count)
    after = k - 1 - place
    p = np.repeat(np.arange(len(k)), after)
    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(after) - after, after)
    return p, q


def matched(a: np.ndarray, b: np.ndarray, of_a, of_b) -> tuple[np.ndarray, np.ndarray]:
    """Children of a and of b by the same character, for pairs of nodes (a, b)."""
    _, _, char_a, _, first, count = of_a
    _, _, char_b, parent_b, _, _ = of_b
    k = count[a]
    left = np.repeat(first[a] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    wanted = np.repeat(b, k) << 21 | char_a[left]
    there = parent_b << 21 | char_b
    at = np.searchsorted(there, wanted)
    hit = at < len(there)
    hit[hit] = there[at[hit]] == wanted[hit]
    return left[hit], at[hit]


def pruned(live: np.ndarray, lo, hi, kids, same, longer):
    """The same without nodes that are not ``live``, numbered anew."""
    c_lo, c_hi, char, parent, first, count = kids
    number = np.cumsum(live) - 1
    stays = live[parent]
    child = np.cumsum(stays) - 1
    count = count[live]
    kids = c_lo[stays], c_hi[stays], char[stays], number[parent[stays]], np.cumsum(count) - count, count
    return lo[live], hi[live], kids, (number[same[0]], number[same[1]]), (number[longer[0]], child[longer[1]])


def within(cut_words: DataFrame) -> DataFrame:
    """(word, near, near_n): pairs of the same subtree, from (prefix, word, n)."""
    def run(batches):
        names, ns, marks, last, group = [], [], [], None, -1
        for batch in batches:
            for prefix, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if prefix != last:
                    if len(names) >= WALK_WORDS:
                        yield from pairs(names, ns, marks)
                        names, ns, marks = [], [], []
                    last, group = prefix, group + 1
                names.append(word)
                ns.append(n)
                marks.append(group)
        yield from pairs(names, ns, marks)

    def pairs(names, ns, marks):
        x, y = near_pairs(names, np.array(marks, np.int64))
        word, n = pa.array(names, pa.string()), pa.array(ns, pa.int64())
        for k in range(0, len(x), 100_000):
            a, b = pa.array(x[k : k + 100_000]), pa.array(y[k : k + 100_000])
            yield pa.RecordBatch.from_arrays([word.take(a), word.take(b), n.take(b)], names=["word", "near", "near_n"])

    def watched(batches):
        kept("spelling", None, dict)
        yield from released(run(batches))

    # UTF-8 sorts as code points do
    dealt = cut_words.select("prefix", "word", "n").repartition("prefix").sortWithinPartitions("prefix", "word")
    return dealt.mapInArrow(watched, "word string, near string, near_n bigint")


def across(cut_words: DataFrame) -> DataFrame:
    """(word, near, near_n): pairs of different subtrees. Words meet by place, beginning and rest;
    ``short`` has nothing at the place, the others one code point each."""
    word, at = F.col("word"), F.col("at")
    head, rest = F.left(word, at), lambda k: F.substring(word, at + k, F.length(word))
    placed = cut_words.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("at"), "depth")
    key = lambda k: F.concat(head, F.lit(PLACE), rest(k))
    one = F.struct(key(2).alias("key"), F.lit(False).alias("short"), (F.substring(word, at + 1, F.lit(1)) != F.substring(word, at + 2, F.lit(1))).alias("last"))
    zero = F.struct(key(1).alias("key"), F.lit(True).alias("short"), F.lit(True).alias("last"))
    both = placed.select("word", "n", F.inline(F.when(at < F.col("depth"), F.array(one, zero)).otherwise(F.array(zero))))
    # `last` tells the last of a run of equal code points: an added one is counted at that place alone
    member = F.struct("word", "n", "short", "last")
    groups = both.groupBy("key").agg(F.collect_list(member).alias("m"), F.count("*").alias("c")).where("c > 1")
    pair = groups.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.word <> y.word")
    pair = pair.where("(NOT x.short AND NOT y.short) OR (x.short AND y.last) OR (y.short AND x.last)")
    return pair.select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def near_words(words: DataFrame, most: int = CUT_WORDS) -> DataFrame:
    """(word, near, near_n) for all pairs of (word, n) at distance one, both ways, once each."""
    cut_words = subtrees(words, most).withColumn("prefix", F.left("word", F.col("depth")))
    cut_words = cut(cut_words.select("prefix", "word", "n", "depth"), "subtrees")
    return within(cut_words).unionByName(across(cut_words))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form). Each round doubles how far a
    word looks; forms are ten times as frequent each, so there are few rounds."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = cut(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def best(near: Column, n: Column) -> Column:
    """Of near words that with the largest n, of equals the smallest."""
    return F.min(F.struct((-n).alias("n"), near.alias("word")))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = CUT_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary."""
    words = cut(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best(F.col("near"), F.col("near_n")).alias("top"))
    known = words.join(near, "word", "left")
    fits = -F.col("top.n") >= TIMES * F.col("n")
    known = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("top.word")).alias("form"), F.when(fits, -F.col("top.n")).alias("form_n")), "known")
    last = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: In this SQL the checksum is computed byte by byte, with its table made by the rule of CRC-32.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM l),
c AS (SELECT doc_id, run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
             lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h FROM x, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL HAVING sum(n) >= 2),
w AS MATERIALIZED (SELECT * FROM v WHERE length(word) >= 7),
k AS MATERIALIZED (SELECT word, n, unnest(range(0, length(word))) AS i FROM w),
e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM k),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM e a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM e a JOIN w b ON a.rest = b.word),
s AS (SELECT word, count(*) AS n_near, max(near_n) AS top_n, arg_min(near, (-near_n, near)) AS top FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM w LEFT JOIN s USING (word)),
o AS (SELECT word, word AS root FROM f UNION ALL SELECT o.word, f.form FROM o JOIN f ON o.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT o.word, o.root FROM o JOIN f ON o.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
