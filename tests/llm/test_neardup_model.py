"""Near-duplicate classes against a model that shares no code with the operator: exact document
frequencies, all pairs, plain dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import neardup


def model(rows, least=0.8):
    """The least id of each row's class, from (id, text)."""
    bags = []
    for _, text in rows:
        w = re.findall(r"\w+", text.lower())
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter())
    df = Counter(s for bag in bags for s in bag)
    weighted = [{s: c * (1 - math.log(df[s] / len(rows))) for s, c in bag.items()} for bag in bags]
    label = {i: i for i, _ in rows}
    links = 0
    for x in range(len(rows)):
        for y in range(x):
            a, b = weighted[x], weighted[y]
            shared = a.keys() & b.keys()
            if not shared:
                continue
            both = sum(min(a[s], b[s]) for s in shared)
            if both / (sum(a.values()) + sum(b.values()) - both) >= least:
                links += 1
                p, q = sorted((label[rows[x][0]], label[rows[y][0]]))
                label = {i: p if v == q else v for i, v in label.items()}
    return label, links


def corpus(seed):
    """Families of edited copies, and many pages with one boilerplate and own text of several lengths: under
    flat weights most of those would be one class."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    for _ in range(40):
        base = said(rng.randrange(40, 160))
        for _ in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    boiler = said(150)
    out += [" ".join(boiler + said(n)) for n in range(1, 60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_under_true_weights(spark, seed):
    rows = corpus(seed)
    wanted, links = model(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_dup_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert links > 20 and got == wanted


def test_counters_are_exact_on_a_small_corpus(spark):
    rows = corpus(3)
    df, n = neardup.document_frequencies(spark.createDataFrame([(t,) for _, t in rows], "text string").repartition(7))
    h, _, bounds = neardup.shingles([t for _, t in rows])
    wanted = Counter(neardup.buckets(h).tolist())
    assert n == len(rows) == len(bounds) - 1 and all(df[k] == c for k, c in wanted.items()) and df.sum() == len(h)


def test_near_copies_of_a_text_with_many_copies(spark):
    """However often a text is copied, its near copies are found: copies do not make it weigh less."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(100)]
    near = [" ".join([*base[:k], "other" + str(k), *base[k + 1 : k + 3], "another" + str(k), *base[k + 4 :]]) for k in range(10, 90, 16)]
    rest = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    rows = list(enumerate([" ".join(base)] * 100 + near + rest + [None, ""]))
    got = {r.doc_id: (r.class_id, r.class_rows) for r in neardup.near_dup_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert [got[i] for i in range(105)] == [(0, 105)] * 105 and all(got[i] == (i, 1) for i in range(105, 307))


def test_equal_texts_are_counted_once(spark):
    rows = [("a b c",)] * 5 + [("a b d",), ("e f",), (None,), (None,), ("",)]
    found = neardup.different(spark.createDataFrame(rows, "text string").repartition(4)).collect()
    assert sorted(str(r.text) for r in found) == sorted(["a b c", "a b d", "e f", "None", ""])
