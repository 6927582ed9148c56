"""Run records, sinks, cases and verdicts on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import CATALOGUE, pid_rules
from tidemark.plans import results, sweeps, verdicts
from tidemark.sources import events as ev
from tidemark.sources import sinks
from tidemark.sources.cases import CaseSource, subset


#: What a column of each kind holds where a test does not care.
ANY = {"string": "-", "bigint": 1, "double": 0.25, "boolean": True}


def record(pattern="random", seed=1, rate="0.10", found=8, total=10, status="completed", case="a", **other):
    """A record with a value of the right kind in every field, and these in those that count."""
    drawn = {"pattern": pattern, "seed": seed, "requested_rate": rate, "detected_label_nodes": found, "total_label_nodes": total, "case_detected": found > 0, "exit_status": status, "case": case}
    return {field: drawn.get(field, ANY[kind]) for field, kind in results.FIELDS.items()} | other


def table(spark, records):
    return results.checked(results.read_json(spark.createDataFrame([(json.dumps(r),) for r in [*records]] + [("",)], "value string")))


def test_contract(spark):
    assert table(spark, [record(), record("baseline", None, mask_sha256=None), record(threshold=1)]).count() == 3
    bad = {"x is missing": {}, "is no bigint": {"deleted_count": True}, "is no string": {"host": 5}, "is no boolean": {"case_detected": 1}, "is no double": {"threshold": "0.5"},
           "known pattern": {"pattern": "odd"}, "known status": {"exit_status": "gone"}, "labelled nodes": {"total_label_nodes": 0, "detected_label_nodes": 0, "case_detected": False}, "detected among labelled": {"detected_label_nodes": 11},
           "case detected": {"case_detected": False}, "seed unless baseline": {"seed": None}, "is no": {"case": None}}
    for message, change in bad.items():
        row = record() | change
        if not change:
            del row["threshold"]
            message = "threshold is missing"
        with pytest.raises(Exception, match=message):
            table(spark, [row]).collect()


def test_effects(spark):
    rows = [record("baseline", None, "0", 10)] + [record("random", s, found=8) for s in (0, 1)] + [record("contiguous", s, found=f) for s, f in ((0, 2), (1, 6))]
    r = results.effects(table(spark, rows)).first()
    assert (r.EC, r.LC_random, r.LC_contiguous, r.E, r.E_severe) == pytest.approx((0.4, 0.2, 0.6, 0.0, 0.5)) and r.EV > 0 and r.EV_ratio is None and r.excluded_reason is None
    o = results.overall(table(spark, rows)).first()
    assert o.saturated and o.metric == "frozen_label_node_recall" and o.evaluable_cases == 1
    o = results.overall(table(spark, [*rows[:3], record("contiguous", 0, found=0), record("contiguous", 1, found=4)])).first()
    assert o.mean_E == 0.5 and o.metric == "case_detection_rate"
    lost = results.effects(table(spark, [record("baseline", None, "0", 0), *rows[1:]])).first()
    assert lost.EC is None and "no baseline" in lost.excluded_reason
    failed = [*rows, record("random", 9, found=0, status="failed")]
    assert results.arms(table(spark, failed)).where("pattern = 'random'").first().seeds == 2
    with pytest.raises(Exception, match="more than one baseline"):
        results.effects(table(spark, [rows[0], *rows])).collect()
    assert results.effects(table(spark, rows[:3])).count() == 0 and results.overall(table(spark, rows[:3])).first().mean_EC is None


def test_sinks_keep_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("a", 0)], "rule string, n int")
    for kind in ("json", "parquet"):
        sinks.write_new(rows, str(tmp_path / kind), kind)
        with pytest.raises(Exception, match="exists"):
            sinks.write_new(rows, str(tmp_path / kind), kind)
    path = str(tmp_path / "shards")
    sinks.write_shards(rows, path, ["rule"])
    got = sinks.stitched(spark, path, ["rule"], [("b",), ("a",)], ["n"]).collect()
    assert [(r.rule, r.n) for r in got] == [("b", 2), ("a", 0), ("a", 1)]
    with pytest.raises(ValueError, match="shards failed"):
        sinks.stitched(spark, path, ["rule"], [("b",), ("c",)], ["n"])
    sinks.write_manifest(spark, path, "run", records=3)
    assert sinks.read_manifest(spark, path)["records"] == 3
    with pytest.raises(Exception, match="exists"):
        sinks.write_manifest(spark, path, "run", records=4)


def test_shards_resume(spark, tmp_path):
    """One shard is killed; the next call runs it alone and sums what all have cost."""
    path, ran = str(tmp_path / "run"), []

    def shard(name, rows, broken=()):
        def make():
            ran.append(name)
            out = spark.range(rows).selectExpr("id AS n", "id % 3 AS k")
            return out.where(F.when(F.lit(name in broken), F.raise_error(F.lit("killed")).cast("boolean")).otherwise(F.lit(True)))

        return make

    sizes, total = {"b": 5, "a": 7, "c": 0}, {"total": F.sum("n")}
    with pytest.raises(RuntimeError, match=r"1 of 3 shards failed: \['a'\]"):
        sinks.run_shards(spark, path, {k: shard(k, n, ("a",)) for k, n in sizes.items()}, total)
    with pytest.raises(ValueError, match="1 shards are missing"):
        sinks.read_shards(spark, path, list(sizes), ["n"])
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")) == ["shard=b", "shard=c"]
    ran.clear()
    sums = sinks.run_shards(spark, path, {k: shard(k, n) for k, n in sizes.items()}, total)
    assert ran == ["a"] and (sums["shards"], sums["rows"], sums["total"]) == (3, 12, 10 + 21) and sums["seconds"] > 0
    assert [r.n for r in sinks.read_shards(spark, path, list(sizes), ["n"]).collect()] == [*range(5), *range(7)]
    manifest = sinks.shard_manifests(spark, path, ["a"])[0]
    assert (manifest["shard"], manifest["rows"], manifest["total"], manifest["engine_version"], manifest["commit"]) == ("a", 7, 21, sinks.ENGINE_VERSION, None)
    spark.conf.set(sinks.COMMIT, "abc")
    try:
        assert sinks.provenance(spark)["commit"] == "abc"
    finally:
        spark.conf.unset(sinks.COMMIT)


def test_case_source(spark, smoke, tmp_path):
    load, asked = lambda case: asked.append(case) or ev.table_events(spark, smoke), []
    raw, cached = CaseSource(spark, load, CATALOGUE), CaseSource(spark, load, CATALOGUE, str(tmp_path / "cache"))
    assert raw.get("a") is raw.get("a") and asked == ["a"]
    cached.fill("a")
    asked.clear()
    columns = ["rule", "seq", "t", "key", "pid"]
    assert sorted(map(tuple, cached.get("a").select(columns).collect())) == sorted(map(tuple, raw.get("a").select(columns).collect())) and not asked
    with pytest.raises(Exception, match="exists"):
        cached.fill("a")
    assert subset(raw.get("a"), "rule", []).count() == raw.get("a").count() and subset(raw.get("a"), "rule", ["mid_cp"]).select("rule").distinct().count() == 1


def test_verdicts(spark):
    cell = lambda rule, m, s, x, drops=0, f=0.2: (rule, f, m, s, 0, x, drops)
    schema = "rule string, fraction double, multiple double, structure string, seed int, alert_reduction double, dropped_late long"
    rows = [cell("a", 2.0, "random", 0.5, 9), cell("a", 5.0, "random", 0.505, 9), cell("a", None, "delete", 0.5), cell("a", 0.5, "random", 0.1), cell("a", 1.0, "random", 0.3)]
    records = spark.createDataFrame(rows, schema)
    assert {(r.multiple, r.holds, r.share, r.adopted) for r in verdicts.beyond_is_delete(records).collect()} == {(2.0, True, 1.0, True), (5.0, True, 1.0, True)}
    r = verdicts.hidden_below_visible(records).first()
    assert (r.hidden, r.visible, r.holds, r.adopted) == (0.3, 0.5, True, True)
    r = verdicts.largest_without_drops(records).first()
    assert (r.multiple, r.reduction) == (1.0, 0.3)
    cells = spark.createDataFrame([("a", 0.2, 1.0, b, x) for b, x in ((0.0, 0.4), (0.5, 0.42), (1.0, 0.2), (2.0, 0.0))], "rule string, fraction double, multiple double, buffer_windows double, evasion_remaining double")
    assert {(r.buffer_windows, r.holds, r.adopted) for r in verdicts.partial_buffer(cells).collect()} == {(0.5, False, False), (1.0, True, False), (2.0, True, False)}
    r = verdicts.staircase(cells).first()
    assert (r.r0, r.rd, r.holds, r.adopted) == (0.4, 0.2, True, True) and verdicts.staircase(cells.where("buffer_windows > 0")).count() == 0
    pairs = [("a", 0.2, 1.0, s, k, x, 30) for s, xs in (("random", (0.1, 0.12, 0.11)), ("targeted", (0.11, 0.1, 0.12))) for k, x in enumerate(xs)]
    evasion = spark.createDataFrame(pairs, "rule string, fraction double, multiple double, structure string, seed int, evasion_rate double, malicious_detected long")
    r = verdicts.targeting_equivalence(evasion, 500).first()
    assert r.holds and r.primary and r.adopted and r.direction is None and r.p025 <= r.p05 <= r.difference <= r.p95 <= r.p975
    r = verdicts.targeting_equivalence(evasion.withColumn("evasion_rate", F.when(F.col("structure") == "targeted", 0.9).otherwise(F.col("evasion_rate"))), 500).first()
    assert not r.holds and not r.adopted and r.direction == "targeted" and r.beyond


def test_marked_subjects_are_the_callers(spark, smoke):
    """Marks from a table and from a condition, other than those of the registered queries."""
    events, rules_, few = ev.table_events(spark, smoke), pid_rules()[:2], {"fractions": (0.2,), "multiples": (2.0,), "seeds": (0,)}
    pids = [r.pid for r in events.select("pid").distinct().orderBy("pid").limit(9).collect()][::2]
    labels = spark.createDataFrame([(p,) for p in pids * 2] + [(None,)], "label bigint")
    by_table = sweeps.targeting_sweep(events, rules_, marked=labels, **few)
    by_condition = sweeps.targeting_sweep(events, rules_, marked=F.col("pid").isin(pids), **few)
    record = lambda df: sorted((r.rule, r.structure, r.malicious_detected, r.malicious_evaded) for r in df.collect())
    assert record(by_table) == record(by_condition) and len(record(by_table)) > 0
    _, stream, rows = sweeps.distorted(events, rules_, structures=("targeted",), marked=labels, **few)
    moved = rows.where("arr <> t").select("pid").distinct()
    assert {r.pid for r in moved.collect()} <= set(pids) and stream.where("marked").select("pid").distinct().count() == len(pids)
    none = sweeps.targeting_sweep(events, rules_, marked=labels.where("false"), **few)
    assert none.where("structure = 'targeted'").isEmpty()
