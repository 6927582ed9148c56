"""Fingerprints, ranked search and spelling variants against plain models, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, search, spelling

LONG = "lorem ipsum dolor sit amet consectetur " * 4000 + "x" * 3000
TEXTS = [
    (9, "The cat sat on the mat and looked at the moon for hours and hours."), (8, "THE CAT sat on the mat; looked at the moon"), (7, None), (6, ""), (5, " \n\t!"),
    (4, LONG), (None, "no id here"), (3, "été à la plage où l'eau était claire"), (3, "été à la plage où l'eau était claire"), (2, "日本語 \U0001F600 ▁ 12345"), (1, "one two"),
]
#: Columns that clash with names used inside the operators.
CLASHING = ["id", "key", "own", "other", "slice", "ghost", "next", "term", "row", "slot", "n", "tf", "hot", "rank", "score", "word", "near", "prefix", "depth", "form", "root", "half", "edited"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low(text))


# 11 fingerprints


def digests(text):
    w, d = terms_of(text), lambda x: hashlib.md5(x.encode()).hexdigest()[:16]
    return {d(" ".join(w[k : k + 5])) for k in range(max(len(w) - 4, 1))} if w else {d(text)} if text else set()


def likeness(a, b, k):
    m = sorted(a | b)[:k]
    return sum(x in a and x in b for x in m) / len(m) if m else 1.0


@pytest.mark.parametrize("k", [128, 3])
def test_fingerprints(docs, k):
    got = sorted((tuple(r) for r in fingerprint.fingerprints(docs, k=k).select("doc_id", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_chars").collect()), key=repr)
    rows = sorted([(i, t or "") for i, t in TEXTS], key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    wanted = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (set(sorted(digests(x))[:k]) for x in (t, edited, after))
        wanted.append((i, hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(b)), likeness(a, b, k), likeness(a, c, k), len(t)))
    assert got == sorted(wanted, key=repr)
    assert fingerprint.fingerprints(docs.where("false")).count() == 0


def test_slices_hold_every_successor(spark):
    """Ids with gaps, repeated ones and none, in many slices."""
    rng = random.Random(5)
    ids = [rng.choice([rng.randrange(50), rng.randrange(10**15), -rng.randrange(10**6)]) for _ in range(700)] + [None] * 3
    rows = [(i, f"text {rng.randrange(10**9)}") for i in ids]
    made = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    bounds = fingerprint.bounds_of(made.withColumn("key", F.coalesce("id", F.lit(fingerprint.NO_ID))), "key")
    assert len(bounds) > 5
    placed, order = fingerprint.with_next(made)
    got = placed.withColumn("after", F.lead("text").over(order)).where("NOT ghost").collect()
    in_order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    wanted = Counter((*a, b[1]) for a, b in zip(in_order, in_order[1:] + in_order[:1]))
    assert Counter((r.id, r.text, r.after) for r in got) == wanted
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and 0 <= one.near_edited < 1


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    parts = [(k % 2, " ".join(rng.choice(words) for _ in range(1500))) for k in range(4)]
    df = spark.createDataFrame(parts, "part int, text string").select("part", fingerprint.sketch(F.col("text")).alias("s"))
    of = {p: sorted(set().union(*(digests(t) for q, t in parts if q == p)))[: fingerprint.K] for p in (0, 1)}
    merged = fingerprint.merged(df, ["part"], "s")
    assert {r.part: r.s for r in merged.collect()} == of
    n = {r.part: r.n for r in merged.select("part", fingerprint.distinct_shingles(F.col("s")).alias("n")).collect()}
    assert all(abs(n[p] / len(set().union(*(digests(t) for q, t in parts if q == p))) - 1) < 0.3 for p in (0, 1))
    pair = spark.createDataFrame([(parts[0][1], parts[0][1][:3000], "")], "a string, b string, c string").select(*[fingerprint.sketch(F.col(c)).alias(c) for c in "abc"])
    got = pair.select(fingerprint.containment(F.col("b"), F.col("a")), fingerprint.containment(F.col("a"), F.col("b")), fingerprint.containment(F.col("c"), F.col("a")), fingerprint.resemblance(F.col("c"), F.col("c"))).first()
    a, b = digests(parts[0][1]), digests(parts[0][1][:3000])
    assert got[0] > 0.95 and abs(got[1] - len(a & b) / len(a)) < 0.15 and got[2] == 1.0 and got[3] == 1.0


# 12 search


def brute_search(items, docs, top):
    lists = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in lists), sum(n for _, _, n in lists)
    df = Counter(t for _, c, _ in lists for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in lists:
            m = 50 + (50 * n * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, -1 if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_search_on_awkward_rows(spark, docs):
    items = [(1, "the cat and THE moon"), (2, None), (3, ""), (4, "lorem été 日本語"), (4, "cat"), (5, "nowhere"), (None, "id two")]
    wanted = brute_search(items, TEXTS, 50)
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("term", F.lit(2))
    for block in (200_000, 3):  # in one block and in many
        got = search.search(table, docs, block_terms=block).collect()
        assert sorted((tuple(r) for r in got), key=repr) == wanted
    assert search.search(table, docs.where("false")).count() == 0 and search.search(table.where("false"), docs).count() == 0


def test_search_ties_and_hot_terms(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(400)]
    rows += [(k + 1000, rows[k % 5][1]) for k in range(80)]  # ties
    items = [(k, " ".join(rng.choice(words) for _ in range(6))) for k in range(25)]
    table, docs = spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    monkeypatch.setattr(search, "BUCKET_ROWS", 100)
    assert sorted((tuple(r) for r in search.search(table, docs, top=9).collect()), key=repr) == brute_search(items, rows, 9)


def test_terms_in_parts(monkeypatch):
    monkeypatch.setattr(search, "STEP", 10)
    for text in ("", "a", "   ", "ab cd ef gh ij kl mn op", "x" * 35 + " y" * 9, " lead and trail ", "été-où " * 7):
        assert [t.decode() for part in search.term_lists(text) for t in part] == terms_of(text)


# 13 spelling


def near(a, b):
    """Distance exactly one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def made_words(seed, n):
    rng = random.Random(seed)
    out = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(n)}
    return sorted(out | {w + "a" for w in list(out)[: n // 8]} | {"x" * k for k in range(7, 40, 3)} | {"x" * 10 + "y", "x" * 11, "aaaaaaab" * 30, "aaaaaaab" * 30 + "c"})


def test_trie_walk():
    for seed in range(4):
        words = made_words(seed, 250)
        for groups in ([0] * len(words), [k // 70 for k in range(len(words))]):
            x, y = spelling.near_pairs(words, np.array(groups))
            wanted = Counter((a, b) for a in range(len(words)) for b in range(len(words)) if groups[a] == groups[b] and near(words[a], words[b]))
            assert Counter(zip(x.tolist(), y.tolist())) == wanted
    assert [len(z) for z in spelling.near_pairs([], np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("most", [1, 4, 60, 10_000])
def test_pairs_do_not_depend_on_the_cut(spark, most):
    words = made_words(7, 300)
    table = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n bigint")
    got = Counter((r.word, r.near, r.near_n) for r in spelling.near_words(table, most).collect())
    assert got == Counter((a, b, k) for a in words for k, b in enumerate(words) if near(a, b))


def brute_spelling(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    by, form, size = {}, {}, {}
    for w in n:  # words that agree without one code point
        for k in range(len(w)):
            by.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for w in n:
        some = set().union(*(by.get(w[:k] + w[k + 1 :], set()) for k in range(len(w))), by.get(w, set()), {w[:k] + w[k + 1 :] for k in range(len(w))} & set(n))
        some = sorted((-n[v], v) for v in some if near(w, v))
        size[w], form[w] = len(some), some[0][1] if some and -some[0][0] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], size[w], n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark, docs):
    rng = random.Random(9)
    words = ["Necessary", "necesary", "nacesary", "corazón", "Corazon", "Año-nuevo"] + [w for w in made_words(1, 60) if len(w) < 20]
    share = [2000, 150, 5, 300, 9, 20] + [3.0 ** (k % 4) for k in range(len(words) - 6)]
    rows = [(k if k % 17 else None, " ".join(rng.choices(words, share, k=rng.randrange(90)))) for k in range(150)] + TEXTS
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    wanted = brute_spelling(rows)
    assert any(x[1] and x[2] != x[1] for x in wanted)  # a form that has a form
    for most in (20_000, 10):
        assert {tuple(r) for r in spelling.spelling_variants(table, most=most).collect()} == wanted
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == brute_spelling(TEXTS)
    assert spelling.spelling_variants(docs.where("false")).count() == 0
