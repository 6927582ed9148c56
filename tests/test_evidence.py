import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import evidence, integrity
from tidemark.sources import events as ev


def test_deletion_count_is_exact():
    assert (evidence.deletion_count(70, "0.07"), evidence.deletion_count(300, "0.57"), evidence.deletion_count(0, "0.5")) == (4, 171, 0)
    for bad in ("sNaN", "-Infinity", "-0.25", "1.01"):
        with pytest.raises(ValueError):
            evidence.deletion_count(10, bad)
    with pytest.raises(ValueError):
        evidence.deletion_count(-1, "0.1")
    with pytest.raises(ValueError):
        evidence.bounds(12, 7, 7)


def test_masks_have_exact_sizes(spark):
    rows = spark.range(1001).select(F.col("id").alias("pos"))
    mask = evidence.masks(spark, 1001, ["0", ".01", ".20", "1"], [0, 1, 2])
    got = {r.run: r for r in evidence.deleted(rows, mask).groupBy("run").agg(F.countDistinct("pos").alias("k"), (F.max("pos") - F.min("pos") + 1).alias("span"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    for m in mask.collect():
        assert (got[m.run].k if m.run in got else 0) == m.k
        if m.pattern == "contiguous" and m.k:
            assert got[m.run].span == m.k and got[m.run].lo >= 0 and got[m.run].hi <= 1000


def test_measure_against_a_plain_model(spark):
    """Drawn events of several processes (some unknown) under drawn masks, some of which take nothing or all."""
    import random

    rng = random.Random(21)
    events = [(p, rng.choice([None, *range(6)]), rng.random() < 0.3) for p in sorted(rng.sample(range(500), 60))]
    none_created = [(p, pid, False) for p, pid, _ in events]
    gone = {run: set(rng.sample([p for p, _, _ in events], k)) | set(rng.sample(range(500), 9)) for run, k in enumerate((0, 5, 30, 55, 60))}
    mask = spark.createDataFrame([(run, ".1", "random", run, 500, len(x)) for run, x in gone.items()], evidence.MASKS)
    taken = spark.createDataFrame([(run, p) for run, x in gone.items() for p in x], "run int, pos bigint")
    for rows in (events, none_created):
        got = {r.run: r for r in evidence.measure(spark.createDataFrame(rows, "pos bigint, pid bigint, is_create boolean"), taken, mask).collect()}
        for run, x in gone.items():
            whole = {pid: all(p in x for p, q, _ in rows if q == pid) for _, pid, _ in rows if pid is not None}
            creates = [p for p, _, create in rows if create]
            counts = (len(rows), sum(p in x for p, _, _ in rows), len(whole), sum(whole.values()), len(creates), sum(p in x for p in creates))
            r = got[run]
            assert (r.events, r.events_deleted, r.processes, r.silenced, r.creates, r.creates_deleted) == counts
            rates = [None if not of else n / of for of, n in zip(counts[::2], counts[1::2])]
            assert [r.event_rate, r.silenced_rate, r.create_rate] == [None if v is None else pytest.approx(v) for v in rates]


def test_node_scores(spark):
    labels = spark.createDataFrame([(f"n{k}",) for k in (1, 2, 3, 4)], "node string")
    score = lambda rows: evidence.score_nodes(spark.createDataFrame(rows, "node string, score double"), labels, 0.5).first()
    assert score([("n1", 0.51), ("n2", 0.5), ("n3", 0.49), ("n4", 0.9)]).detected == 2
    assert score([("n1", 0.9), ("n2", 0.9)]).absent == 2
    assert score([("n1", 0.9), ("x", 0.9), ("y", 0.9)]).precision == pytest.approx(1 / 3)
    assert score([("n1", 0.1)]).precision is None
    with pytest.raises(ValueError):
        score([("n1", 0.1), ("n1", 0.2)])


def test_positions_and_offsets(spark, smoke):
    rows = ev.positions(ev.table_events(spark, smoke).select("seq", "t"), "t", "seq")
    got = [r.pos for r in rows.orderBy("t", "seq").collect()]
    assert got == list(range(len(got)))
    bad = spark.createDataFrame([("2019-09-23T11:00:00",)], "ts string").select(ev.micros(F.col("ts")))
    with pytest.raises(Exception, match="without an offset"):
        bad.collect()


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(x), float(x * x)) for x in range(1, 11)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    q = {r.k: r for r in stats.index_quantiles(df, ["k"], "x", {"p90": 0.9}).collect()}
    assert q["a"].p90 == 9.0 and q["b"].p90 == 1.0
    rho = {r.k: r.rho for r in stats.spearman(df, ["k"], "x", "y").collect()}
    assert rho["a"] == pytest.approx(1) and rho["b"] is None
    n, mean, sd, *_ = stats.summary("x")
    assert {r.k: r.sd for r in df.groupBy("k").agg(n, mean, sd).collect()}["b"] == 0.0
    big = spark.createDataFrame([("a", float(x % 37)) for x in range(500)] + [("b", 2.0), ("b", None)], "k string, x double")
    whole, cut = (sorted(map(tuple, stats.index_quantiles(big, ["k"], "x", {"lo": 0.1, "hi": 0.9}, most=m).collect())) for m in (10**6, 20))
    values = sorted(float(x % 37) for x in range(500))
    assert whole == cut and cut[0] == ("a", 500, values.count(0.0), 0.0, values[int(0.1 * 499)], values[int(0.9 * 499)], 36.0) and cut[1][:2] == ("b", 1)
    drawn = [("a", float(x * 7 % 11), float(x % 5)) for x in range(400)] + [("b", 1.0, None), ("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    frame = spark.createDataFrame(drawn, "k string, x double, y double")
    import pandas as pd

    own = pd.DataFrame([r[1:] for r in drawn[:400]])
    for m in (10**6, 4):
        rho = {r.k: (r.n, r.rho) for r in stats.spearman(frame, ["k"], "x", "y", m).collect()}
        assert rho["a"][0] == 400 and rho["a"][1] == pytest.approx(own[0].rank().corr(own[1].rank())) and rho["c"] == (2, None) and "b" not in rho
        got = {r.k: (r.n, r.lo, r.mid) for r in stats.quantiles(frame, ["k"], "x", {"lo": 0.123, "mid": 0.5}, m).collect()}
        assert got["a"] == (400, pytest.approx(own[0].quantile(0.123)), pytest.approx(own[0].quantile(0.5))) and got["b"] == (1, 1.0, 1.0)
    arms = spark.createDataFrame([("c", a, k, v) for a in ("t", "r") for k, v in enumerate((0.1, 0.2, 0.3))], "k string, arm string, seed int, v double")
    r = stats.bootstrap_difference(arms, ["k"], "arm", "t", "r", "v").first()
    assert r.difference == pytest.approx(0) and r.p025 < r.p05 < 0 < r.p95 < r.p975


def test_pins_and_compare(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    pinned = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "name string, sha256 string")
    assert {r.name: r.status for r in integrity.verify_pins(found, pinned).collect()} == {"a": "ok", "b": "mismatch", "c": "missing"}
    assert tuple(integrity.compare(found, pinned, ["name"], ["sha256"]).first()) == (1, 0, 1)


def test_masks_are_refused(spark):
    rows = [(1, k, p) for k, p in enumerate((3, 5, 9))] + [(2, k, p) for k, p in enumerate((3, 3, 9))] + [(3, 0, 40)] + [(4, 0, 4)] + [(5, 0, 4)]
    facts = [(k, evidence.MASK_TAG if k != 4 else "other", n, "x", "y" if k == 5 else "x") for k, n in ((1, 3), (2, 3), (3, 1), (4, 1), (5, 1), (6, 2))]
    masks = spark.createDataFrame(rows, "run int, place bigint, pos bigint")
    assert {r.run: r.reason for r in evidence.validate_mask(masks, 0, 20).collect()} == {2: "not sorted and unique", 3: "outside the selection"}
    found = evidence.validate_mask(masks, 0, 20, spark.createDataFrame(facts, "run int, schema string, k bigint, source_sha256 string, input_sha256 string"))
    assert {r.run: r.reason for r in found.collect()} == {2: "not sorted and unique", 3: "outside the selection", 4: "another schema", 5: "another input", 6: "another count"}


def test_window_must_be_pure_if_asked(spark):
    rows = spark.createDataFrame([(0, 5, None), (1, 12, 5), (2, 30, 12), (3, 14, 30)], "pos bigint, t bigint, before bigint")
    r = evidence.window_positions(rows, 10, 20).first()
    assert (r.in_window, r.order_violations, r.selection_start, r.selection_end) == (2, 1, 1, 4)
    with pytest.raises(Exception, match="outside"):
        evidence.window_positions(rows, 10, 20, pure=True).collect()


def test_files_and_members(spark, tmp_path):
    import gzip
    import hashlib

    raw = gzip.compress(b'{"id": "a"}\n{"id": "b"}\n')
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.json.gz").write_bytes(raw)
    (r,) = integrity.file_hashes(spark, str(tmp_path / "m")).collect()
    assert (r.size, r.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
    r = integrity.stored_member(spark, str(tmp_path / "m/one.json.gz"), len(raw), ev.EVENT).first()
    assert (r.sha256, r.events) == (hashlib.sha256(raw).hexdigest(), 2)
    with pytest.raises(ValueError, match="size"):
        integrity.stored_member(spark, str(tmp_path / "m/one.json.gz"), 7, ev.EVENT)
    (tmp_path / "cut.json.gz").write_bytes(raw[:-9])
    with pytest.raises(Exception):
        integrity.stored_member(spark, str(tmp_path / "cut.json.gz"), len(raw) - 9, ev.EVENT).collect()


def test_index_entries(spark):
    schema = "name string, file_id string, data_offset bigint, size bigint"
    one = ("x/host1.json.gz", "f", 512, 10)
    assert integrity.select_member(spark.createDataFrame([one, one, ("x/host2.json.gz", "f", 1, 1)], schema), "host1.json.gz").count() == 1
    for rows in ([one, ("x/host1.json.gz", "f", 1024, 10)], [("other", "f", 0, 1)]):
        with pytest.raises(ValueError, match="one indexed member"):
            integrity.select_member(spark.createDataFrame(rows, schema), "host1.json.gz")


def test_artefacts_must_agree(spark):
    a = spark.createDataFrame([("c", "1", 5)], "case string, sha string, start int")
    assert integrity.same_facts(a, a, ["case"], ["sha", "start"]).count() == 1
    for other, message in ((a.withColumn("start", F.lit(6)), "differ in start"), (a.where("false"), "missing")):
        with pytest.raises(Exception, match=message):
            integrity.same_facts(a, other, ["case"], ["sha", "start"]).collect()
