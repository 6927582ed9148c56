"""Rules, lateness, buffers and folds against plain models on small streams."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import slicing
from tidemark.operators import detect, distort, reorder
from tidemark.operators.rules import Rule

S = 1_000_000


def naive(events, w, n, allowed=0):
    """(alerts, dropped, accepted) of (t, key) in order of arrival, event by event; an alert is
    (key, event, count, first and last time of the fullest span that holds it)."""
    mark, held, alerts, dropped = None, {}, [], 0
    for t, key in events:
        if key is None:
            continue
        if mark is not None and t < mark - w - allowed:
            dropped += 1
            continue
        mark = t if mark is None else max(mark, t)
        own = sorted([*held.get(key, []), t])
        spans = [[x for x in own if a <= x <= a + w] for a in own if t - w <= a <= t]
        best = max(spans, key=len)  # of equals the earliest
        if len(best) >= n:
            alerts.append((key, t, len(best), best[0], best[-1]))
            own = []
        held[key] = own
    return alerts, dropped, sum(k is not None for _, k in events) - dropped


def frame(spark, streams, w, n):
    rows = [(run, k, t * S, key) for run, events in enumerate(streams) for k, (t, key) in enumerate(events) if key is not None]
    df = spark.createDataFrame(rows, "run int, seq bigint, occ bigint, key string")
    return df.withColumns({"arr": F.col("seq"), "w": F.lit(w * S).cast("long"), "n": F.lit(n)})


def check(spark, streams, w, n, allowed=0):
    """Once with everything in one slice, once in many slices and with every key taken for hot."""
    for width, most in ((None, 10**9), (7, 2)):
        marked = detect.mark_late(frame(spark, streams, w, n), allowed * S, width=width).cache()
        kept = marked.where("NOT late")
        hot = detect.hot_keys(kept, "run", most=most)
        got = {r.run: r for r in detect.summary(marked, [n], allowed * S, hot=hot).collect()}
        keys, fired = {}, {}
        for r in detect.subjects(kept, [n], hot).collect():
            keys.setdefault(r.run, set()).add(r.key)
        for r in detect.alerts(kept, allowed * S, hot=hot, slice_rows=3 if width else 500_000).collect():
            fired.setdefault(r.run, []).append((r.key, r.fired_at // S, r["count"], r.window_start // S, r.window_end // S))
        marked.unpersist()
        for run, events in enumerate(streams):
            alerts, dropped, accepted = naive(events, w, n, allowed)
            if run in got:
                assert (got[run].alerts, got[run].dropped_late, got[run].accepted, keys.get(run, set())) == (len(alerts), dropped, accepted, {a[0] for a in alerts}), events
                assert sorted(fired.get(run, [])) == sorted(alerts), events


def check_in_order(spark, streams, w, n):
    """Without a fold by row, and with every key taken for hot."""
    wanted = sorted((run, *a) for run, events in enumerate(streams) for a in naive(events, w, n)[0])
    rows = frame(spark, streams, w, n)
    for hot in (None, detect.hot_keys(rows, "run", most=0)):
        got = sorted((r.run, r.key, r.fired_at // S, r["count"], r.window_start // S, r.window_end // S) for r in detect.alerts_in_order(rows, [n], hot, slice_rows=4).collect())
        assert got == wanted


def one(*times):
    return [(t, "a") for t in times]


def test_worked_examples(spark):
    streams = [one(0, 10, 20), one(0, 10, 100), one(0, 1, 2, 3, 4, 5), [(0, "a"), (1, "b"), (2, "a"), (3, "b")], one(600, 0, 10, 20), one(0, 10, 600, 20), one(20, 0, 10), one(20, 40, 0), [(1, None)] * 3]
    check(spark, streams, 60, 3)
    check(spark, streams, 60, 3, 600)
    check(spark, streams, 60, 3, 60)
    check(spark, [[(100, "a"), (110, "a"), (160, "b"), (100, "a"), (161, "b"), (120, "a")]], 60, 4)


def test_permutations_agree_with_enough_lateness(spark):
    streams = [one(*p) for p in permutations((0, 5, 12, 30, 41, 55))]
    marked = detect.mark_late(frame(spark, streams, 60, 3), 120 * S)
    assert {r.alerts for r in detect.summary(marked, [3], 120 * S).collect()} == {2}


def test_random_streams(spark):
    rng = random.Random(11)
    for allowed in (0, 20):
        streams = [[(rng.randrange(0, 300), rng.choice("abc")) for _ in range(rng.randrange(1, 40))] for _ in range(120)]
        check(spark, streams, 25, 3, allowed)


def test_streams_in_order(spark, monkeypatch):
    monkeypatch.setattr(detect, "CHUNK", 3)  # many chunks a stretch
    rng = random.Random(3)
    for w, n, step in ((25, 3, 12), (25, 1, 40), (60, 5, 15), (10, 4, 4), (0, 2, 2)):
        streams = [sorted((rng.randrange(0, step * 40), rng.choice("ab")) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
        check_in_order(spark, [*streams, one(*range(0, 300, 2)), one(*[5] * 30)], w or 1, n)


def test_one_dense_key_in_slices(spark):
    """One hot key without gaps, not in order, in many slices, equals the plain fold."""
    rng = random.Random(17)
    times = [max(0, 3 * k - rng.choice([0, 0, 0, 5, 40, 90])) for k in range(60_000)]
    w, n, mark, kept = 100, 7, None, []
    for t in times:
        if mark is None or t >= mark - w:
            kept.append(t)
            mark = t if mark is None else max(mark, t)
    rows = spark.createDataFrame([(0, "a", k, k, t, w, n) for k, t in enumerate(kept)], "run int, key string, arr bigint, seq bigint, occ bigint, w bigint, n int")
    got = detect.alerts(rows, hot=detect.hot_keys(rows, "run", most=1000), slice_rows=9_000)
    wanted = detect.fold([], kept, w, n)
    assert sorted((r.fired_at, r["count"], r.window_start, r.window_end) for r in got.collect()) == sorted(wanted) and len(wanted) > 1000


def test_guards(spark):
    for bad in ((0, 60), (3, 0)):
        with pytest.raises(ValueError):
            Rule("x", "o", "a", "pid", bad[1], bad[0])
    with pytest.raises(Exception, match="no threshold 3"):
        detect.subjects(frame(spark, [one(1, 2)], 60, 3), [4]).collect()
    with pytest.raises(Exception, match="a buffer is 0 or more"):
        reorder.buffered(frame(spark, [one(1)], 60, 3).withColumn("buffer", F.lit(-1).cast("long"))).collect()
    with pytest.raises(ValueError):
        detect.mark_late(frame(spark, [one(1)], 60, 3), -1)


def test_buffer_is_the_heap(spark):
    import heapq

    rng = random.Random(4)
    for size in (0, 1, 50, 300):
        events = sorted((t + rng.choice([0, 0, 40, 300]), t, k) for k, t in enumerate(rng.sample(range(1000), 30)))
        heap, out = [], []
        for k, (arr, occ, _) in enumerate(events):
            heapq.heappush(heap, (occ, k))
            while heap and heap[0][0] <= arr - size:
                out.append(heapq.heappop(heap))
        out += [heapq.heappop(heap) for _ in range(len(heap))]
        rows = spark.createDataFrame([(0, k, a, o, size) for k, (a, o, _) in enumerate(events)], "run int, seq bigint, arr bigint, occ bigint, buffer bigint")
        for width in (None, 13, 400):
            got = reorder.released_order(reorder.buffered(rows, width=width)).orderBy(*reorder.ORDER).collect()
            assert [(r.occ, r.seq) for r in got] == out


def test_order_across_slices(spark):
    for times, plain, strict in (((1, 2, 2, 5), True, False), ((1, 2, 3, 5), True, True), ((1, 3, 2, 9), False, False), ((), None, None)):
        rows = spark.createDataFrame([(0, 10 * k, k, t) for k, t in enumerate(times)], "run int, arr bigint, seq bigint, occ bigint")
        for width in (None, 10, 20, 1000):
            got = [reorder.in_order(rows, strictly=s, width=width).collect() for s in (False, True)]
            assert [r[0].ordered if r else None for r in got] == [plain, strict]


def test_running_values_across_slices(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.randrange(-5, 6)) for g in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    for width in (None, 1, 7, 100):
        got = slicing.numbered(slicing.running(slicing.running(df, ["g"], ["k"], "k", F.sum, "v", "total", width), ["g"], ["k"], "k", F.max, "v", "top", width), ["g"], ["k"], "k", "place", width)
        for r in slicing.previous(got, ["g"], ["k"], "k", "v", "last", width).collect():
            own = [v for g, k, v in rows if g == r.g and k < r.k]
            assert (r.total, r.top, r.last, r.place) == ((sum(own), max(own), own[-1], len(own) + 1) if own else (None, None, None, 1))


def test_slices_follow_bursts(spark):
    """Nine rows of ten in a hundredth of the time: no slice has twice what it should, and none of the small groups counts."""
    rng = random.Random(6)
    rows = [("a", rng.randrange(500_000, 510_000) if rng.random() < 0.9 else rng.randrange(1_000_000)) for _ in range(20_000)]
    rows += [("b", rng.randrange(1_000_000)) for _ in range(9_000)] + [("c", 7)] * 300
    df = spark.createDataFrame(rows, "g string, x bigint")
    bounds = slicing.width_of(df, ["g"], "x", 1000)
    cut, many = slicing.sliced(df, ["g"], "x", bounds)
    assert many and max(r["count"] for r in cut.groupBy("g", "_s").count().collect()) <= 2000
    wrong = cut.where(F.col("_s") != F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("x"))))
    assert wrong.isEmpty() and slicing.width_of(df, ["g"], "x", 20_000) is None
    got = slicing.numbered(df.withColumn("k", F.monotonically_increasing_id()), ["g"], ["x", "k"], "x", "place", bounds)
    for r in got.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("p")).collect():
        assert [p.place for p in r.p] == list(range(1, len(r.p) + 1)) and [p.x for p in r.p] == sorted(x for g, x in rows if g == r.g)


def test_held_times_are_let_go():
    """A key that never fires keeps what later spans can reach, and no more."""
    held = []
    assert detect.fold(held, list(range(0, 100_000, 10)), 25, 4) == [] and len(held) <= detect.HELD + 1
    rng = random.Random(9)
    times, w = [rng.randrange(0, 4000) + 3 * k for k in range(3000)], 40
    kept, mark = [], None
    for t in times:
        if mark is None or t >= mark - w:
            kept.append(t)
            mark = t if mark is None else max(mark, t)
    assert [x[0] for x in detect.fold([], kept, w, 5)] == [a[1] for a in naive([(t, "a") for t in kept], w, 5)[0]]


def test_distortion_properties(spark):
    rows = spark.createDataFrame([("r", k, 100 * k * S, str(k % 3), 7 if k % 2 else 1, 60 * S, 3) for k in range(40)], "rule string, seq bigint, t bigint, key string, pid bigint, w bigint, n int")
    runs = distort.grid(spark, [Rule("r", "o", "a", "pid", 60, 3)], (0.2,), (5.0,), (0, 1))
    chosen = distort.chosen(distort.draws(rows, runs), runs).cache()
    picked = {}
    for r in chosen.where("chosen").collect():
        picked.setdefault((r.structure, r.seed), set()).add(r.seq)
    assert picked["random", 0] == picked["delete", 0] != picked["random", 1] and len(picked["random", 0]) == 8
    assert len(picked["targeted", 0]) == 4 and all(s % 2 for s in picked["targeted", 0])
    m1, m2 = distort.arrive(chosen), distort.arrive(chosen, clock="M2")
    assert m1.where("structure <> 'delete'").count() == 160 and m1.where("structure = 'delete'").count() == 64
    assert m1.where("occ <> t").isEmpty() and m2.where("occ <> arr").isEmpty()
    with pytest.raises(ValueError):
        distort.arrive(chosen, clock="M3")
