"""Each operator on awkward rows, and against a brute-force version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exactdedup, langid, linededup, media, neardup, packing, pii, suffixtree, urlfilter, wfst

LONG = "lorem ipsum dolor " * 3000 + "x" * 500
AWKWARD = [
    (1, "The cat sat on the mat and looked at the moon.", "en"),
    (2, "THE CAT SAT ON THE MAT AND LOOKED AT THE MOON.", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\t ", "en"),
    (6, LONG, "la"),
    (None, "no id here", None),
    (7, "été à la plage, où l'eau était très claire", "fr"),
    (7, "été à la plage, où l'eau était très claire", "fr"),
    (8, "日本語 \U0001F600 ▁ 12345", None),
]
#: Columns that clash with names used inside the operators.
CLASHING = ["row", "node", "_row", "_d", "_h", "digest", "row_id", "batch", "word", "n", "key", "_new", "_lang", "score", "window_id", "id", "d", "h", "t", "pos"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, "doc_id bigint, text string, lang string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# 1 media


def test_media_round_trip(docs, none):
    rows = {(r.doc_id, r.n_bytes): r for r in media.media_report(docs).collect()}
    for doc_id, text, _ in AWKWARD:
        raw = (text or "").encode()
        filled = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(filled), hashlib.sha256(filled).hexdigest(), zlib.crc32(filled[-32:]))
    assert media.media_report(none).count() == 0


def test_media_files_and_clips(docs):
    stored = media.encode_column(docs)
    made = {r.doc_id: r.avi for r in stored.collect()}
    assert made[6][:4] == b"RIFF" and media.parse_avi(made[6])[0] == media.FPS
    clips = media.clips(stored).collect()
    of_long = sorted((r.clip, r.first_frame, r.last_frame, r.start_s) for r in clips if r.doc_id == 6)
    assert of_long[0][1] == 0 and all(a[2] + 1 == b[1] and b[3] == b[1] / media.FPS for a, b in zip(of_long, of_long[1:]))
    assert {r.doc_id for r in clips} == {x[0] for x in AWKWARD}


def test_media_shot_at_a_change():
    rng = np.random.default_rng(1)
    frames = np.concatenate([rng.integers(0, 60, (20, 576)), rng.integers(120, 250, (20, 576))]).astype(np.uint8)
    assert media.shots(media.histograms(frames)).tolist() == [0, 20]
    assert media.shots(media.histograms(frames[:0])).tolist() == []


def test_shots_against_plain_loops():
    rng = np.random.default_rng(4)
    frames = np.concatenate([rng.integers(a, a + 60, (n, 576)) for a, n in ((0, 9), (120, 3), (60, 20), (180, 1), (0, 12))]).astype(np.uint8)
    shares = [[sum(1 for x in f if x // 16 == b) / 576 for b in range(16)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(shares, shares[1:])]
    wanted = [0]
    for k, x in enumerate(d):
        around = [d[j] for j in range(max(0, k - media.AROUND), min(len(d), k + media.AROUND + 1)) if j != k]
        mean = sum(around) / len(around)
        spread = math.sqrt(max(0.0, sum(y * y for y in around) / len(around) - mean * mean))
        if x > max(mean + media.SPREADS * spread, media.FLOOR) and (k == 0 or x >= d[k - 1]) and (k + 1 == len(d) or x > d[k + 1]):
            wanted.append(k + 1)
    assert media.shots(media.histograms(frames)).tolist() == wanted and len(wanted) > 1


def test_media_long_text_and_damaged_file(spark):
    import resource

    raw = ("one line of a very long text\n" * 700_000).encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (data,) = media.encode_texts([raw])
    ((_, frames),) = media.read_back([data])
    assert b"".join(f.tobytes() for f in frames)[: len(raw)] == raw
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300  # MB for 20 MB
    good = media.encode_texts([b"short"])[0]
    rows = [(1, bytearray(good)), (2, bytearray(b"RIFFxxxxAVI broken")), (3, bytearray(good[:-90])), (4, bytearray(b"no")), (5, None)]
    found = {r.doc_id for r in media.clips(spark.createDataFrame(rows, "doc_id bigint, avi binary")).collect()}
    assert 1 in found and not found & {2, 4, 5}


def test_media_without_index():
    data = media.encode_texts([b"hello" * 500])[0]
    plain = data[: data.rfind(b"idx1")]
    assert media.parse_avi(plain)[1] == media.parse_avi(data)[1]


def test_baseline_picture():
    """A grey baseline picture of flat 8 x 8 blocks, coded by hand: each block a DC difference and an end of block."""
    def bits(value: int) -> str:
        s = abs(value).bit_length()
        return f"{s:04b}" + (f"{value if value > 0 else value + (1 << s) - 1:0{s}b}" if s else "") + "0"

    levels, before, code = [10, 200, 128, 7], 0, ""
    for v in levels:
        dc = v - 128
        code, before = code + bits(dc - before), dc
    code += "1" * (-len(code) % 8)
    data = bytes(int(code[k : k + 8], 2) for k in range(0, len(code), 8)).replace(b"\xff", b"\xff\0")
    seg = media.segment
    dc_table = bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])
    ac_table = bytes([16, 1, *[0] * 15, 0])
    picture = b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, bytes([8, 0, 16, 0, 16, 1, 1, 0x11, 0])) + seg(0xC4, dc_table) + seg(0xC4, ac_table) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    found = media.decode_frames([picture])[0]
    assert found.shape == (16, 16)
    assert [found[0, 0], found[0, 15], found[15, 0], found[15, 15]] == levels and len(np.unique(found)) == 4


# 2 packing


def test_packing_is_exact(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(docs, size=64, windows=4, with_ids=True).collect()
    wanted = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, _ in AWKWARD)
    pieces: dict = {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    got: Counter = Counter()
    for (i, _), p in pieces.items():
        p.sort()
        copies = sum(s == 0 for s, _ in p)
        for k in range(copies):
            got[i, tuple(x for _, ids in p[k::copies] for x in ids)] += 1
    assert got == wanted
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 64
    assert packing.pack(none).count() == 0


def test_packer_best_fit_and_emission():
    p = packing.Packer(10, 2, 0)
    assert p.place(6)[:2] == (0, 0) and p.place(7)[:2] == (1, 0)
    assert p.place(3)[:2] == (1, 7)  # the fullest that takes it
    assert p.place(5)[0] == 2 and p.place(6)[2] == 0  # none fits: the fullest leaves


@pytest.mark.parametrize("text", ["don't I'll 'tis ''s", "<|endoftext|> x", "İstanbul ß ﬁ ½ ²3", "日本語", "a\x85b\xa0c", "", "\x1c\x1d a", "naïve É"])
def test_words_give_the_tokenizers_ids(text):
    w = packing.word_tokens(packing.default_tokenizer())
    assert w.encode([text])[0].tolist() == w.whole.encode(text, add_special_tokens=False).ids


# 3 lines


def brute_lines(rows, span=3):
    first, out = {}, []
    for d, text in rows:
        lines = text.split("\n")
        dead = set()
        for p in range(len(lines) - span + 1):
            w = tuple(lines[p : p + span])
            if not any(x.strip(" ") for x in w):
                continue
            if w not in first:
                first[w] = (d, p)
            else:
                fd, fp = first[w]
                dead |= set(range(max(p, fp + span) if fd == d else p, p + span))
        out.append((d, "\n".join(x for k, x in enumerate(lines) if k not in dead)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(d, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14)))) for d in range(60)]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == brute_lines(rows)


def test_line_dedup_awkward(docs, none):
    got = linededup.line_dedup(docs)
    assert got.columns == docs.columns and got.count() == len(AWKWARD)
    assert {r.doc_id: r.text for r in got.collect()}[3] is None
    assert linededup.line_dedup(none).count() == 0


# 4 urls


def test_host_path_and_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q#f", "x://example.net", "http://example.com/de/1", "https://b.org/fr/", "http://borg/fr/", "http://h.net?x=/en/", "ftp://u#frag", "a://b://c/d"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge_urls(rows, np.zeros(64), 0.0).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("a.example.net", "/en/x", "example.net/en/"), 3: ("example.net", "", None),
        4: ("example.com", "/de/1", "example.com/de/"), 5: ("b.org", "/fr/", "org/fr/"), 6: ("borg", "/fr/", None),
        7: ("h.net", "", None), 8: ("u", "", None), 9: ("b:", "//c/d", None),
    }
    assert urlfilter.judge_urls(rows.where("false"), np.zeros(64), 0.0).count() == 0


def test_training_matches_numpy_and_generalises(spark):
    labelled = urlfilter.labelled_table(spark)
    host, path = urlfilter.host_path(F.col("url"))
    rows = labelled.select(urlfilter.ngram_buckets(host, path, (3, 4), 1024).alias("f"), "label").collect()
    x = np.zeros((len(rows), 1024))
    for k, r in enumerate(rows):
        x[k, r.f] = 1 / math.sqrt(max(len(r.f), 1))
    y = np.array([r.label for r in rows])
    w, b, v, u = np.zeros(1024), 0.0, np.zeros(1024), 0.0
    for _ in range(5):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        v, u = 0.9 * v - 6.0 * (x.T @ e / len(y) + 1e-4 * w), 0.9 * u - 0.6 * e.mean()
        w, b = w + v, b + u
    got, intercept = urlfilter.train(labelled, buckets=1024, steps=5)
    assert np.allclose(got, w) and abs(intercept - b) < 1e-9
    held = lambda url: zlib.crc32(url.split("/")[2].encode()) % 5 == 0
    weights, intercept = urlfilter.train(spark.createDataFrame([x for x in urlfilter.LABELLED if not held(x[0])], "url string, label int"))
    pages = spark.createDataFrame([(label, url) for url, label in urlfilter.LABELLED if held(url)], "page_id int, url string")
    verdicts = Counter((r.page_id, r.verdict) for r in urlfilter.judge_urls(pages, weights, intercept, rules=[("nowhere", "/", "block")]).collect())
    right, all_ = verdicts[0, "allow"] + verdicts[1, "block"], sum(verdicts.values())
    assert right / all_ > 0.75 and verdicts[0, "allow"] > 5 * verdicts[0, "block"]


def test_url_rules_awkward(spark):
    rows = spark.createDataFrame([(1, "http://example.net/en/x"), (1, "http://example.net/en/x"), (None, None), (2, "")], "page_id bigint, url string")
    got = urlfilter.url_rules(rows).collect()
    assert len(got) == 4 and {(r.page_id, r.rule) for r in got} == {(1, "example.net/en/"), (None, None), (2, None)}
    assert urlfilter.url_rules(rows.where("false")).count() == 0


# 5 exact


def test_exact_dedup(docs, none):
    rows = exactdedup.exact_dedup(docs).collect()
    assert len(rows) == len(AWKWARD) and exactdedup.exact_dedup(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(len(g) == g[0].group_size and sum(r.kept for r in g) == 1 for g in by.values())
    assert by[hashlib.sha256(b"").hexdigest()][0].keep_id == 4  # null counts as empty
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {2}


def test_exact_dedup_of_a_second_batch(spark):
    a = exactdedup.digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id bigint, text string"))
    b = exactdedup.digests(spark.createDataFrame([(4, "a"), (5, "c")], "doc_id bigint, text string"))
    from tidemark.llm._scratch import scratch_path

    index = exactdedup.DigestIndex(spark, "second_batch", scratch_path(spark, "index"), 4)
    index.add(a)
    index.add(b)
    assert index.table().count() == 3
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in index.resolve(b).collect()) == [(4, 3, False), (5, 5, True)]


# 6 transducer


def brute_path(m, text):
    raw = (" " + text).encode()
    words = {m.text[i].decode().replace(wfst.MARK, " ").encode(): m.cost[i] for i in set(m.final[m.final >= 0].tolist())}
    best = [0.0] + [math.inf] * len(raw)
    for p in range(len(raw)):
        best[p + 1] = min(best[p + 1], best[p] + m.byte_cost[raw[p]])
        for q in range(p + 1, min(len(raw), p + m.depth) + 1):
            if raw[p:q] in words:
                best[q] = min(best[q], best[p] + words[raw[p:q]])
    return best[-1]


def test_transducer_takes_the_shortest_path():
    e = wfst.encoder(wfst.default_model())
    for text in ["hello world", " two  spaces ", "été \U0001F600", "x" * 60, "日本語とenglish", "a\nb\tc"]:
        ids, cost = e.encode([text])[0]
        assert abs(cost - brute_path(e.m, text)) < 1e-6 and e.decode(ids) == text
        own = sum(e.m.byte_cost[e.m.text[i][0]] if i in set(e.m.byte_id.tolist()) else e.m.cost[i] for i in ids)
        assert abs(own - cost) < 1e-6


def test_transducer_report(docs, none):
    rows = wfst.transducer_report(docs).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(AWKWARD)
    assert {r.doc_id: r.n_ids for r in rows}[4] == 0 and wfst.transducer_report(none).count() == 0
    back = {r.doc_id: r.text for r in wfst.decode(wfst.encode(docs)).collect()}
    assert back[1] == AWKWARD[0][1] and back[3] == ""


# 7 suffix tree


def brute_tree(rows, depth, least, shared):
    """score of each (id, text, held): contexts as byte strings in dictionaries."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    streams = [(i, b"\n" * depth + b"".join(w + b" " for w in (x or "").encode().translate(low).split()) + b"\n", held) for i, x, held in rows]
    after: dict = {}
    for _, raw, held in streams:
        for k in range(depth, len(raw)):
            for d in range(depth + 1):
                if not held:
                    after.setdefault(raw[k - d : k], Counter())[raw[k]] += 1

    def good(ctx):
        own, total = after[ctx], sum(after[ctx].values())
        if len(ctx) <= shared:
            return True
        up, up_total = after[ctx[1:]], sum(after[ctx[1:]].values())
        gain = sum(n * math.log((n / total) / (up[s] / up_total)) for s, n in own.items())
        return total >= least and gain >= 0.5 * len(own) * math.log(total) - 1e-9

    retained = {ctx[k:] for ctx in after if good(ctx) for k in range(len(ctx) + 1)}

    def p(symbol, ctx):
        lower = 1 / 256 if ctx == b"" else p(symbol, ctx[1:])
        own = after.get(ctx, {})
        return (own.get(symbol, 0) + len(own) * lower) / (sum(own.values()) + len(own)) if own else lower

    def score(raw):
        total = 0.0
        for k in range(depth, len(raw)):
            d = next(d for d in range(depth, -1, -1) if raw[k - d : k] in retained or not d)
            total += math.log10(p(raw[k], raw[k - d : k]))
        return total

    return {i: score(raw) for i, raw, _ in streams}, retained


def test_suffix_tree_against_brute_force(spark, docs, none):
    rng = random.Random(8)
    made = [(100 + k, " ".join(rng.choice(["abra", "abracadabra", "cad", "dabra", "Été", "x"]) for _ in range(rng.randrange(30)))) for k in range(30)]
    rows = [(i, x) for i, x, _ in AWKWARD if i != 6] + made
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    assert set(held.values()) == {True, False}
    found = {}
    for r in suffixtree.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("batch", F.lit(1))).collect():
        found.setdefault(r.doc_id, r)
    wanted, retained = brute_tree([(i, x, held[i]) for i, x in rows], suffixtree.DEPTH, suffixtree.LEAST_COUNT, suffixtree.SHARED)
    assert max(map(len, retained)) == suffixtree.DEPTH
    for i, value in wanted.items():
        assert found[i].score == pytest.approx(value, rel=1e-4), i
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(i, (x or "").encode().translate(low).split()) for i, x in rows]
    c = Counter(w for i, t in tokens if not held[i] for w in [*t, b"\n"])
    n, v = sum(c.values()), len(c)
    for i, t in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, b"\n"])
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t) + 1, sum(w in c for w in [*t, b"\n"]), n)
        assert r.base_score == pytest.approx(base)
    assert suffixtree.lm_scores(none).count() == 0 and suffixtree.lm_scores(docs).count() == len(AWKWARD)


def test_suffix_tree_without_training_rows(spark):
    one = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = suffixtree.lm_scores(spark.createDataFrame([(one, "ab")], "doc_id bigint, text string")).first()
    assert (r.train_tokens, r.n_known) == (0, 0) and r.score == pytest.approx(4 * math.log10(1 / 256), rel=1e-5)


def test_long_texts_in_parts(monkeypatch):
    """Small limits must not change words, grams or sums."""
    text = "Some words\tof different lengths, " * 40
    whole = [w for part in suffixtree.parts_of(text) for w in part]
    monkeypatch.setattr(suffixtree, "PART", 10)
    assert [w for part in suffixtree.parts_of(text) for w in part] == whole == text.encode().lower().split()
    raw = np.frombuffer(b"\n" * 5 + b"abc \n" + b"\n" * 5 + b"\n" + b"\n" * 5 + b"abcabc \n", np.uint8)
    firsts, keys = np.array([0, 10, 16]), np.unique(suffixtree.grams(raw, 5))
    logs = suffixtree.Lookup(keys, np.arange(1, len(keys) + 1, dtype=np.float32))
    full = suffixtree.text_scores(raw, firsts, 5, logs)
    for stretch in (1, 3, 6, 7):
        monkeypatch.setattr(suffixtree, "STRETCH", stretch)
        assert suffixtree.text_scores(raw, firsts, 5, logs).tolist() == full.tolist()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    raw = np.frombuffer(b"\n" * 5 + bytes(rng.choice(list(b"abc "), 4000).tolist()), np.uint8)
    keys, n = np.unique(suffixtree.grams(raw, 5), return_counts=True)
    low = suffixtree.Low(keys, n)
    context = int(keys[n.argmax()]) >> 8 << 8
    family = np.unique(np.append(keys[(keys >> 8 & suffixtree.LOW) == (context >> 8 & suffixtree.LOW)], context + np.arange(256)))
    logs = suffixtree.probabilities(family, suffixtree.at(keys, n, family), low, 5, 2)
    assert (10.0 ** logs[np.isin(family, context + np.arange(256))].astype(float)).sum() == pytest.approx(1, abs=1e-4)


# 8 language


def test_language_forward_sums_all_segmentations():
    m = wfst.Pieces(wfst.default_model())
    rng = np.random.default_rng(0)
    p = rng.uniform(1e-5, 1e-2, (m.size, 2))

    def total(raw):
        ways = [np.ones(2)] + [np.zeros(2) for _ in raw]
        for a in range(len(raw)):
            ways[a + 1] = ways[a + 1] + ways[a] * p[m.byte_id[raw[a]]]
            state, b = 1, a
            while b < len(raw) and 0 < state < m.inner:
                state = m.next[state, raw[b]]
                b += 1
                if state and m.final[state] >= 0:
                    ways[b] = ways[b] + ways[a] * p[m.final[state]]
        return np.log(ways[-1])

    units = [" the".encode(), " été".encode(), " internationalisation".encode()]
    got = langid.forward(m, units, p)
    for u, g in zip(units, got):
        assert np.allclose(g, total(u)) and np.allclose(langid.forward_long(m, u, p), g)


def test_training_counts_every_segmentation():
    m = wfst.Pieces(wfst.default_model())
    p = np.random.default_rng(3).uniform(1e-5, 1e-2, m.size)

    def ways(unit, at=0):
        if at == len(unit):
            yield []
        for q, i in langid.arcs_at(m, unit, at) if at < len(unit) else []:
            yield from ([i, *rest] for rest in ways(unit, q))

    units, wanted = [b" the", " été".encode(), b" into"], np.zeros(m.size)
    for k, u in enumerate(units, 1):
        found = list(ways(u))
        mass = [math.prod(p[i] for i in way) for way in found]
        for way, x in zip(found, mass):
            for i in way:
                wanted[i] += k * x / sum(mass)
    assert np.allclose(langid.expected_counts(m, units, np.array([1.0, 2.0, 3.0]), p), wanted)


def test_long_units_fall_apart_exactly():
    m = wfst.Pieces(wfst.default_model())
    rng, e = random.Random(6), wfst.Encoder(m)
    p = np.random.default_rng(2).uniform(1e-4, 1e-1, (m.size, 2))
    for letters in ("日本語東京大学international", "abc", "é😀-", "x"):
        unit = (" " + "".join(rng.choice(letters) for _ in range(300))).encode()
        parts = wfst.segments(m, unit)
        assert b"".join(parts) == unit and (len(parts) > 50 or letters in "abcx")
        assert abs(sum(c for _, c in map(lambda x: wfst.shortest_long(m, x), parts)) - wfst.shortest_long(m, unit)[1]) < 1e-6
        assert np.allclose(langid.forward(m, parts, p).sum(axis=0), langid.forward_long(m, unit, p))
        ids, cost = e.encode([unit[1:].decode()])[0]
        assert abs(cost - wfst.shortest_long(m, unit)[1]) < 1e-6 and e.decode(ids) == unit[1:].decode()


def test_language_id(spark, docs, none):
    en, fr = "the cat and the dog were in the garden with a ball", "le chat et le chien sont dans le jardin avec une balle"
    rows = [(k, (en if k % 2 else fr).replace("a", "a" * (1 + k % 2)), "en" if k % 2 else "fr") for k in range(40)] + [(99, None, "en"), (100, "x", None)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    test = spark.createDataFrame([(1, "the dog with the cat"), (2, "le chien dans une balle"), (3, None), (4, "12 34"), (5, "")], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(test, model).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "fr", "und", "und", "und"] and 0 <= got[1][1] <= 1
    found = langid.identify(docs, model, out=("p", "q"))
    assert found.columns == [*docs.columns, "p", "q"] and found.count() == len(AWKWARD)
    empty = langid.learn(none)
    assert {r.p for r in langid.identify(docs, empty, out=("p", "q")).collect()} == {"und"}
    assert langid.identify(none, model, out=("p", "q")).count() == 0


def test_language_id_learns_from_long_units(spark):
    m = wfst.Pieces(wfst.default_model())
    p = np.random.default_rng(2).uniform(1e-5, 1e-3, m.size)
    for unit in (b" hello", " 日本語のx".encode()):
        assert np.allclose(langid.expected_counts_long(m, unit, 3.0, p), langid.expected_counts(m, [unit], np.array([3.0]), p))
    rng = random.Random(4)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(60))
    a, b = "日本語東京大学", "中国人民北上海"
    rows = [(k, text(a if k % 2 else b), "ja" if k % 2 else "zh") for k in range(20)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    test = spark.createDataFrame([(k, text(a if k % 2 else b)) for k in range(10)], "doc_id bigint, text string")
    assert all(r.lang_pred == ("ja" if r.doc_id % 2 else "zh") and r.score > 0.99 for r in langid.identify(test, model).collect())


SCRIPTS = {"am": "ሀለሐመሠረሰሸቀበተኀነኘአከኸወዐዘየደጀገጠጨጰጸፀፈፐ", "jv": "ꦄꦆꦈꦌꦎꦏꦒꦔꦕꦗꦚꦛꦝꦟꦠꦢꦤꦥꦧꦩꦪꦫꦭꦮꦱꦲ", "got": "𐌰𐌱𐌲𐌳𐌴𐌵𐌶𐌷𐌸𐌹𐌺𐌻𐌼𐌽𐌾𐌿𐍀𐍂𐍃𐍄𐍅𐍆𐍇𐍈𐍉"}


def test_scripts_outside_the_vocabulary(spark):
    """Units of 10 to 160 bytes whose every byte has the least probability there is."""
    m = wfst.Pieces(wfst.default_model())
    p = np.full((m.size, 2), 1e-9)
    size = np.array([len(x) for x in m.text])
    for letters in SCRIPTS.values():
        for n in (3, 10, 15, 20, 31, 36, 40):
            unit = (letters * 2)[:n].encode()
            log = langid.forward(m, [unit], p)[0]
            assert np.isfinite(log).all() and np.allclose(log, langid.forward_long(m, unit, p))
            counts = langid.expected_counts(m, [unit], np.array([2.0]), p[:, 0])
            assert abs((counts * size).sum() - 2 * len(unit)) < 1e-6
            assert np.allclose(counts, langid.expected_counts_long(m, unit, 2.0, p[:, 0]))
    mixed = [" the".encode(), (SCRIPTS["am"][:30] + "international").encode(), b"x" * 160]
    q = np.random.default_rng(8).uniform(1e-9, 1e-2, m.size)
    together = langid.expected_counts(m, mixed, np.array([1.0, 2.0, 3.0]), q)
    assert np.allclose(together, sum(langid.expected_counts_long(m, u, k, q) for k, u in enumerate(mixed, 1)))
    rng = random.Random(1)
    rows = [(k, " ".join("".join(rng.choice(s) for _ in range(rng.randrange(3, 40))) for _ in range(9)), lang) for k, (lang, s) in enumerate(list(SCRIPTS.items()) * 12)]
    model = langid.learn(spark.createDataFrame([r for r in rows if r[0] < 24] + [(k, "der Hund und die Katze", "de") for k in range(90, 99)], "doc_id bigint, text string, lang string"))
    got = langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang and 0.99 < r.score <= 1 for r in got)
    unseen = langid.learn(spark.createDataFrame([(1, "der Hund", "de"), (2, "the dog", "en")], "doc_id bigint, text string, lang string"))
    assert all(0 <= r.score <= 1 for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), unseen).collect())


# 9 near duplicates


def test_near_dup_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 160))]
        for c in range(rng.randrange(1, 7)):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((k, " ".join(text)))
            k += 1
    got = {r.doc_id: r.class_id for r in neardup.near_dup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    h, c, b = neardup.shingles([t for _, t in rows])
    idf = neardup.idf_table(np.bincount(neardup.buckets(h), minlength=1 << neardup.DF_BITS), len(rows))
    vectors = neardup.weighted_jaccard([t for _, t in rows], idf)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if neardup.similarity(vectors[i], vectors[j]) >= 0.8:
                a, z = label[i], label[j]
                label = [min(a, z) if x in (a, z) else x for x in label]
    assert got == dict(enumerate(label))


def test_near_dup_pair_that_never_leads(spark):
    """One bucket of 40 texts whose most central members are near nothing; the other two are twins."""
    texts = [" ".join(f"t{k}w{j}" for j in range(40)) for k in range(39)]
    texts.append(texts[38])
    nodes = [(bytearray([k]), [1, 2, 3, 4 if k < 38 else k]) for k in range(40)]
    found = neardup.links_of(
        spark.createDataFrame(nodes, "node binary, sig array<int>"),
        spark.createDataFrame([(n, t) for (n, _), t in zip(nodes, texts)], "node binary, text string"),
        np.ones(1 << neardup.DF_BITS, np.float32), 0.8, 2, 2,
    )
    assert found is not None and {(bytes(r.node)[0], bytes(r.label)[0]) for r in found.collect()} == {(38, 38), (39, 38)}


def test_near_dup_awkward(docs, none):
    rows = neardup.near_dup_report(docs).collect()
    assert len(rows) == len(AWKWARD)
    classes = {}
    for r in rows:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes[2] == {1} and classes[3] == {3} and classes[4] == {4} and classes[None] == {None}
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None, 7, 8])
    assert neardup.near_dup_report(none).count() == 0 and neardup.near_dedup(none).count() == 0


def test_weights_follow_shares_at_any_size():
    """The share of documents decides, whatever their number and the collisions of rare shingles."""
    rng = np.random.default_rng(1)
    weights = []
    for n in (2_000, 200_000):
        df = np.bincount(rng.integers(0, 1 << neardup.DF_BITS, 300 * n), minlength=1 << neardup.DF_BITS)
        df[7] += n // 2
        df[8] += n // 20
        weights.append(neardup.idf_table(df, n)[[7, 8, 9]])
    assert np.allclose(weights[0], weights[1], atol=0.1) and np.allclose(weights[1], 1 - np.log([0.5, 0.05, neardup.RARE_SHARE]), atol=0.1)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.sort(np.append(a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)))
    wa, wb = rng.uniform(1, 6, 300), rng.uniform(1, 6, 300)
    s = neardup.samples(np.append(a, b), np.append(wa, wb).astype(np.float32), np.array([0, 300, 600]), 1024)
    assert abs((s[0] == s[1]).mean() - neardup.similarity((a, wa), (b, wb))) < 0.06


# 10 personal data


def test_feistel_permutes():
    for size in (1, 2, 10, 1000, 4097):
        assert sorted(pii.permute(b"k", "t", n, size) for n in range(size)) == list(range(size))


def test_pseudonyms_keep_formats():
    key = b"secret"
    card = pii.card(key, "4041-8949-7460-8795")
    assert pii.luhn(card.replace("-", "")) == 0 and card[4] == "-" and card != "4041-8949-7460-8795"
    assert pii.card(key, "4041894974608796") is None and pii.ip(key, "256.1.1.1") is None and pii.ssn(key, "000-12-3456") is None
    assert pii.iban_rest(pii.iban(key, "DE89370400440532013000")[:2], pii.iban(key, "DE89370400440532013000")[2:4], pii.iban(key, "DE89370400440532013000")[4:]) == 1
    same = {pii.pseudonymise(t, key)[0] for t in ("2024-02-29", "29.02.2024", "02/29/2024")}
    days = {tuple(sorted(t.replace("-", ".").replace("/", ".").split("."))) for t in same}
    assert len(days) == 1
    assert pii.pseudonymise("version 3. CC BY-NC 4.0. 2024-13-01", key) == ("version 3. CC BY-NC 4.0. 2024-13-01", 0)


@pytest.mark.parametrize("writings", [("+353 1 234 5678", "+35312345678", "+353-1-2345678"), ("+49 (30) 1234567", "+49301234567"), ("+1 (988) 555-2485", "988-555-2485", "+19885552485"), ("+7 912 345-67-89", "+79123456789")])
def test_one_number_has_one_pseudonym(writings):
    digits = {"".join(filter(str.isdigit, pii.pseudonymise(f"call {w}, now", b"k")[0])).removeprefix("1" if w[0] != "+" or w[1] == "1" else "") for w in writings}
    assert len(digits) == 1 and all(pii.pseudonymise(f"call {w}, now", b"k")[1] == 1 for w in writings)


def test_recognition_against_planted_values():
    """Texts put together from values of known kinds and from what must stay."""
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + number(14)
        return next(d + c for c in "0123456789" if pii.luhn(d + c) == 0)

    def iban():
        own = number(18)
        return f"DE{98 - pii.iban_rest('DE', '00', own):02d}{own}"

    planted = {
        "card": card, "iban": iban, "ip": lambda: f"{rng.randint(1, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "iso": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        "phone": lambda: f"+44 20 {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}", "email": lambda: f"{rng.choice('abc')}{number(3)}@mail.example.org",
    }
    stays = ["alpha", "v1.2.3", "2024", "3/4", "page 12", "000-12-3456", "999.1.1.1", "2024-13-40", "1234567890123456789012", "a@b", "x-1-2", "50%", "$1,234.56"]
    seen: dict = {}
    for _ in range(300):
        parts = [(None, rng.choice(stays)) if rng.random() < 0.5 else (k := rng.choice([*planted]), planted[k]()) for _ in range(8)]
        text, count = pii.pseudonymise(" ; ".join(x for _, x in parts), b"k")
        assert count == sum(k is not None for k, _ in parts)
        for (kind, before), after in zip(parts, text.split(" ; "), strict=True):
            assert before == after if kind is None else len(before) == len(after) or kind == "ip"
            if kind:
                assert seen.setdefault((kind, before), after) == after
    assert len(set(seen.values())) == len(seen)


def test_equal_values_stay_linked(spark, docs, none):
    rows = [(1, "call +1 (988) 555-2485 or mail bob.42@mail8.example.com", "x"), (2, "mail bob.42@mail8.example.com, card 4041894974608795 at 70.123.182.155", "y")]
    a, b = (r.text for r in pii.pii(spark.createDataFrame(rows, "doc_id int, text string, n string")).orderBy("doc_id").collect())
    assert a.split()[-1] == b.split()[1].rstrip(",") != "bob.42@mail8.example.com"
    assert all(x not in a + b for x in ("555-2485", "4041894974608795", "70.123.182.155"))
    assert pii.pii(docs).columns == docs.columns and pii.pii(docs).count() == len(AWKWARD) and pii.pii(none).count() == 0


def test_each_place_is_replaced_once():
    """Numbers inside an address belong to it, and what an address becomes is not looked at again."""
    rng = random.Random(5)
    for k in range(1000):
        local = "".join(rng.choice("0123456789") for _ in range(16))
        for text in (f"{local}@x.com", "555-123-4567@x.com", "+1 555-123-4567@x.com", f"70.1.2.{k % 250}@mail.org", f"see 2024-02-29, {local}@x.com; 1.2.1980"):
            after, count = pii.pseudonymise(text, b"k")
            local_at = text.split("@")[0].split(" ")[-1]
            assert count == 1 + (", " in text) * 2
            assert after.split("@")[0].split(" ")[-1] == pii.made(b"k", "email", local_at + "@" + text.split("@")[1].split(";")[0]).split("@")[0]


@pytest.mark.parametrize("form", ["{d}.{m}.{y}", "{m}/{d}/{y}", "{d}/{m}/{y}"])
def test_dates_are_permuted_within_their_format(form):
    """All days of some years, written with and without leading zeros: different ones stay different,
    each with as many digits in each field."""
    from datetime import date, timedelta

    seen: dict = {}
    for n in range(0, 366 * 3):
        x = date(1999, 1, 1) + timedelta(n)
        for d in {str(x.day), f"{x.day:02d}"}:
            for m in {str(x.month), f"{x.month:02d}"}:
                text = form.format(d=d, m=m, y=x.year)
                after, count = pii.pseudonymise(text, b"k")
                shape = lambda t: [len(p) for p in t.replace("/", ".").split(".")]
                assert count == 1 and shape(after) == shape(text)
                assert seen.setdefault(after, text) == text


def test_pipeline_ready_tables(spark):
    """Null, empty and very long texts, no rows, and columns that clash."""
    rows = [(1, None), (2, ""), (3, "call 988-555-2485 " * 20_000), (3, "call 988-555-2485 " * 20_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_new": F.lit(1), "n": F.lit(2), "key": F.lit(3)})
    got = {r.doc_id: (r.text, r.found) for r in pii.pii(table, count_col="found").collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[3][1] == 20_000 and "988-555-2485" not in got[3][0]
