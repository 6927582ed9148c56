"""All runs over one copy of the stream: in slices and for hot keys as in one piece, and without a shuffle per run."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import compact, detect, distort, rules
from tidemark.plans import queries, sweeps
from tidemark.sources import events as ev


def records(grid, with_alerts, buffers):
    return sorted(map(tuple, sweeps.detected(grid.evaluated(with_alerts, buffers)).collect())), sorted(map(tuple, sweeps.sums(grid.evaluated(with_alerts, buffers)).collect()))


@pytest.mark.parametrize(("delay", "buffers"), [("fixed", (0.0, 0.5, 2.0)), ("lognormal", (0.0, 0.5, 2.0)), ("burst", (0.0, 1.0)), ("uniform", None)])
def test_slices_and_hot_keys(spark, smoke, delay, buffers):
    """Many slices of time and keys that are cut give what one slice gives."""
    events = ev.table_events(spark, smoke)
    options = {"structures": ("random",) if buffers else ("random", "targeted", "delete"), "fractions": (0.3,), "seeds": (0,), "multiples": (1.0, 2.0)}
    whole = sweeps.Grid.of(events, queries.RULES[1:3], delay=delay, **options)
    wanted = records(whole, True, buffers)
    days = np.array([queries.START + k * 43_200_000_000 for k in range(-10, 40, 3)])
    sliced = replace(whole, sizes=sweeps.Sizes(days, None))
    assert records(sliced, True, buffers) == wanted and wanted[0] and wanted[1]
    hot = detect.hot_keys(whole.rows.withColumn("occ", F.col("t")), "rule", most=20)
    assert records(replace(whole, sizes=sweeps.Sizes(days, hot)), True, buffers) == wanted


def shuffled(spark, job) -> int:
    """Records that the stages of a job write to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    empty = lambda: gateway.jvm.java.util.ArrayList()

    def written():
        stages = store.stageList(empty(), False, False, gateway.new_array(gateway.jvm.double, 0), empty())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    job()
    return written() - before


def test_no_shuffle_per_run(spark, smoke):
    """A mitigation sweep (32 cells a rule here) shuffles a few times its stream, and so does a sweep of 42 runs a rule."""
    events, one = ev.table_events(spark, smoke), queries.PID[:1]
    n = events.count()
    options = {**queries.MITIGATION, "seeds": (0, 1, 2, 3)}
    assert shuffled(spark, lambda: sweeps.mitigation_sweep(events, one, **options).collect()) < 30 * n + 10_000
    assert shuffled(spark, lambda: sweeps.ordering_sweep(events, one, with_alerts=False).collect()) < 12 * n + 30_000


@pytest.mark.parametrize("digits", [3, 7])
def test_draws_are_those_of_the_whole_digest(spark, smoke, monkeypatch, digits):
    """Where the digits that travel with a row are equal, the whole digest decides."""
    monkeypatch.setattr(compact, "PICK_DIGITS", digits)
    events = ev.table_events(spark, smoke)
    options = {"fractions": (0.05, 0.3), "seeds": (3, 0), "multiples": (1.0, 2.0)}
    runs, rows = sweeps.moving(events, queries.PID[:2], **options)
    got = rows.select("rule", "seq", F.explode("moves.run").alias("run"))
    wanted = distort.chosen(distort.draws(rules.project(events, queries.PID[:2]), runs), runs).where("chosen").select("rule", "seq", "run")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_no_null_lists_reach_python(spark, smoke, monkeypatch):
    """A null list costs Arrow's writer as many steps as there are nulls before it."""
    events, seen = ev.table_events(spark, smoke), []
    kind = type(events)
    plain = kind.mapInArrow

    def spy(df, *args, **kwargs):
        if "moves" in df.columns:
            seen.append(df.where("moves IS NULL").count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    sweeps.ordering_sweep(events, queries.PID[:1], with_alerts=False, fractions=(0.2,), seeds=(0,)).collect()
    assert seen == [0, 0]


def test_digests_are_taken_once_per_event(spark, smoke, monkeypatch):
    """Runs and rules share a row's digests: rows that a run moves are found without another."""
    events, asked = ev.table_events(spark, smoke), []
    cut = compact.cut
    monkeypatch.setattr(compact, "cut", lambda df, name: (asked.append((name, df._jdf.queryExecution().optimizedPlan().toString())), cut(df, name))[1])
    sweeps.moving(events, queries.PID[:2], fractions=(0.2,), seeds=(0, 1))
    assert [plan.count("md5") for name, plan in asked if name == "places"] == [0]


def test_rows_are_held_against_slices_in_reach(spark, smoke, monkeypatch):
    """Rows meet slices by number, not each row all slices of its rule."""
    grid = sweeps.Grid.of(ev.table_events(spark, smoke), queries.RULES[1:3], fractions=(0.3,), seeds=(0,), multiples=(1.0, 2.0))
    days, plans = np.array([queries.START + k * 86_400_000_000 for k in range(20)]), []
    kind = type(grid.rows)
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *_: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    for before in (False, True):
        compact.verdicts(grid.rows, grid.runs, days, before)
    joins = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 5 and all("_s#" in line or "slice#" in line for line in joins)


@pytest.mark.parametrize("buffers", [(0.0, 1.0), None])
def test_gaps_are_not_copied_to_each_slice(spark, smoke, monkeypatch, buffers):
    """A burst moves all rows of a window; slices that lie in it get the ends of the gap, not its rows."""
    grid = sweeps.Grid.of(ev.table_events(spark, smoke), queries.RULES[:1], delay="burst", structures=("random",), fractions=(0.4,), seeds=(0, 1), multiples=(2.0,))
    hours, rows, kind = np.array([queries.START + k * 3_600_000_000 for k in range(0, 24 * 30, 3)]), [], type(grid.rows)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *args: ("place" in df.columns and rows.append(df.count())) or plain(df, *args))
    whole, sliced = (sorted(map(repr, replace(grid, sizes=sweeps.Sizes(width, None)).evaluated(True, buffers).where("key IS NOT NULL").collect())) for width in (None, hours))
    assert sliced == whole != []
    one, many = rows
    assert many <= one + 2 * 2 * (len(hours) + 1)  # two runs have two ends each


def test_ends_of_slices_are_hashed(spark, smoke, monkeypatch):
    """What looks at each row once per run does not sort those rows."""
    grid = sweeps.Grid.of(ev.table_events(spark, smoke), queries.RULES[:1], fractions=(0.3,), seeds=(0,), multiples=(1.0, 2.0))
    plans, cut = {}, compact.cut
    monkeypatch.setattr(compact, "cut", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), cut(df, name))[1])
    compact.verdicts(grid.rows, grid.runs, np.array([queries.START + k * 86_400_000_000 for k in range(20)]), even=True)
    assert "SortAggregate" not in plans["edges"]


def test_alerts_by_stretches(monkeypatch):
    """Alerts counted by stretches are those of the fold, and what arrives in order is not folded."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        monkeypatch.setattr(detect, "SIDE_BY_SIDE", 2 + 30 * (trial % 2))
        m, w, n = int(rng.integers(0, 120)), int(rng.integers(1, 40)), int(rng.integers(1, 7))
        keys, t = np.sort(rng.integers(0, rng.integers(1, 60), m)), rng.integers(0, rng.integers(5, 2000), m)
        arr = t + (rng.random(m) < rng.choice([0, 0.05, 0.3])) * rng.integers(0, 3 * w + 1, m)
        order = np.lexsort((arr, keys))
        keys, t = keys[order], t[order]
        wanted = {int(k): c for k in np.unique(keys) if (c := len(detect.fold([], t[keys == k].tolist(), w, n)))}
        assert dict(zip(*map(np.ndarray.tolist, detect.alert_counts(keys, t, w, n)))) == wanted
    far = np.array([0, 1, 2, 1 << 61, 3, (1 << 61) + 1])  # too far apart to number all keys' times in one line
    assert [x.tolist() for x in detect.alert_counts(np.array([0, 0, 0, 1, 1, 1]), far, 5, 2)] == [[0, 1], [1, 1]]
    monkeypatch.setattr(detect, "fired", None)
    assert [x.tolist() for x in detect.alert_counts(np.zeros(1000, int), np.arange(1000), 5, 5)] == [[0], [200]]


@pytest.mark.parametrize("with_alerts", [False, True])
def test_keys_are_counted_where_they_meet(spark, smoke, with_alerts):
    """Counts and lists of keys are those of the keys that each run detects, with hot keys and without."""
    options = {"fractions": (0.3,), "seeds": (0,), "multiples": (1.0, 2.0)}
    for clock in ("M1", "M2"):
        grid = sweeps.Grid.of(ev.table_events(spark, smoke), queries.RULES[1:3], clock=clock, **options)
        rule = {r.run: r.rule for r in grid.runs.collect()} | {r.run: r.rule for r in sweeps.numbers(spark, grid.rules).collect()}
        keys = {run: {} for run in rule}
        for r in sweeps.detected(grid.evaluated(with_alerts)).collect():
            keys[r.run][r.key] = r.alerts
        base = {rule[run]: set(found) for run, found in keys.items() if run < 0}
        hot = detect.hot_keys(grid.rows.withColumn("occ", F.col("t")), "rule", most=20)
        for own in (grid, replace(grid, sizes=sweeps.Sizes(None, hot))):
            got = sweeps.sums(own.evaluated(with_alerts, listed=compact.NONE)).collect()
            assert {r.run: (r["keys"], r.known, r.alerts) for r in got} == {run: (len(f), len(base[rule[run]] & set(f)), sum(f.values()) if with_alerts else None) for run, f in keys.items()}
            lost = sweeps.detected(own.evaluated(with_alerts, listed=compact.LOST)).select("run", "key").collect()
            assert sorted(map(tuple, lost)) == sorted((run, k) for run, f in keys.items() for k in base[rule[run]] - set(f)) != []


@pytest.mark.parametrize("sweep", [sweeps.ordering_sweep, sweeps.targeting_sweep, sweeps.mitigation_sweep])
def test_no_list_of_keys_per_run(spark, smoke, monkeypatch, sweep):
    """What a sweep keeps of its evaluation has no row for each key and run: joined, such a list went through the driver."""
    rows, cut = {}, sweeps.cut
    monkeypatch.setattr(sweeps, "cut", lambda df, name: (out := cut(df, name), rows.update({name: out.count()}))[0])
    records = sweep(ev.table_events(spark, smoke), queries.PID[:1], fractions=(0.05,), seeds=(0, 1), multiples=(0.5, 2.0)).collect()
    cells = 1 + (16 if sweep is sweeps.mitigation_sweep else 10)
    assert records and rows["evaluated"] <= cells * 4  # so many for each partition
