"""All runs of a grid over one copy of the stream.

A run differs from the stream by the rows that it moves or deletes, so a row is kept once, with
``moves``: (run, delay) for each run that moves it, the delay null where it is deleted. Only moved rows
can be late, so only they are looked up, in slices of time; then the rows of a key meet once and all
runs of its rule are evaluated there. Nothing is shuffled once per run but what the run moves.

What a moved row needs to know of its run is (p) the time of the arrival before it, and (m) the least
event time above its own + W among earlier arrivals. It is late if there is such a one; behind a
buffer of B > 0, if m <= p - B: that row was released before. A row leaves such a buffer by its own
arrival if p >= occ + B, else by the first arrival at occ + B or later. So the order of release is that of
the larger of p and occ + B, rows of the second kind first, then (arr, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sampling import PREFIX_BITS, digest
from tidemark.functions.slicing import slice_number
from tidemark.operators import detect
from tidemark.sources.scratch import cut

DRAW = ["rule", "seed", "targeted"]
LEAST, MOST = -(1 << 62), 1 << 62
#: Rows that are evaluated at once; a key's rows stay together.
CHUNK_ROWS = 100_000


#: Hexadecimal digits of a draw's digest that travel with a row; the whole digest decides where they are equal.
PICK_DIGITS = 7


def pick(h: Column) -> Column:
    return F.conv(F.substring(h, 1, PICK_DIGITS), 16, 10).cast("int")


def picks(seeds) -> Column:
    """Where ``seq`` stands in the draw of each seed, by seed: digested once, for all rules and runs."""
    return F.array(*[pick(digest("pick", F.lit(s), F.col("seq"))) for s in sorted(set(seeds))])


def own_pick(seeds) -> Column:
    return F.get("picks", (F.array_position(F.array(*map(F.lit, sorted(set(seeds)))), F.col("seed")) - 1).cast("int"))


def bounds(stream: DataFrame, runs: DataFrame, seeds) -> DataFrame:
    """(rule, seed, targeted, fraction, h, last): the last row that is chosen, in the order of (digest, seq).
    Rows are counted by slices of the digest's range, and only those of the slice that holds it are digested and sorted."""
    few = runs.select("rule", "seed", (F.col("structure") == "targeted").alias("targeted"), "fraction").distinct()
    rows = stream.select("rule", "seq", "marked", "picks").join(F.broadcast(few.select(*DRAW).distinct()), "rule").where("NOT targeted OR marked")
    rows = rows.withColumn("_slice", F.shiftright(own_pick(seeds), 4 * PICK_DIGITS - PREFIX_BITS)).drop("picks")
    sizes = rows.groupBy(*DRAW, "_slice").agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*DRAW)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_n": F.sum("_c").over(own)})
    place = F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("fraction"))))
    at = sizes.join(F.broadcast(few), DRAW).withColumn("_k", place - F.col("_before")).where("_k > 0 AND _k <= _c")
    at = cut(at.select(*DRAW, "fraction", "_slice", "_k"), "places")  # a row per draw and fraction
    order = Window.partitionBy(*DRAW, "fraction").orderBy("_h", "seq")
    near = rows.join(F.broadcast(at), [*DRAW, "_slice"]).withColumn("_h", digest("pick", F.col("seed"), F.col("seq")))
    near = near.withColumn("_own", F.row_number().over(order)).where("_own = _k")
    return near.select(*DRAW, "fraction", F.col("_h").alias("h"), F.col("seq").alias("last"))


def moved(stream: DataFrame, runs: DataFrame, seeds, delay) -> tuple[DataFrame, DataFrame]:
    """(``stream`` with ``moves`` instead of ``picks``, the runs that exist). ``delay`` is a function of w, multiple, seed and
    seq. A targeted run without eligible rows does not exist."""
    wide = runs.withColumn("targeted", F.col("structure") == "targeted").join(F.broadcast(bounds(stream, runs, seeds)), [*DRAW, "fraction"])
    wide = cut(wide, "bounds")
    run = F.struct("run", "multiple", (F.col("structure") == "delete").alias("gone"))
    draws = wide.groupBy("rule", "seed", "targeted", "h", "last").agg(F.collect_list(run).alias("runs"))
    at = (F.array_position(F.array(*map(F.lit, sorted(set(seeds)))), F.col("seed")) - 1).cast("int").alias("at")
    known = draws.groupBy("rule").agg(F.collect_list(F.struct("seed", at, "targeted", pick(F.col("h")).alias("pick"), "h", "last", "runs")).alias("_draws"))  # a row per rule
    rows = stream.join(F.broadcast(known), "rule")
    seq, w = F.col("seq"), F.col("w")

    def taken(x):
        own, h = F.get("picks", x["at"]), digest("pick", x["seed"], seq)
        return (~x["targeted"] | F.col("marked")) & ((own < x["pick"]) | ((own == x["pick"]) & ((h < x["h"]) | ((h == x["h"]) & (seq <= x["last"])))))

    one = lambda x, r: F.struct(r["run"].alias("run"), F.when(~r["gone"], delay(w, r["multiple"], x["seed"], seq)).alias("delay"))
    moves = F.flatten(F.transform(F.filter("_draws", taken), lambda x: F.transform(x["runs"], lambda r: one(x, r))))
    return cut(rows.withColumn("moves", moves).drop("_draws", "picks"), "moved"), wide.select(*runs.columns)


def moved_in_bursts(stream: DataFrame, runs: DataFrame, delay) -> tuple[DataFrame, DataFrame]:
    """The same by whole slots of length W: see ``distort.burst``."""
    first = stream.groupBy("rule").agg(F.min("t").alias("_t0"), F.count("*").alias("_n"))  # a row per rule
    slotted = stream.join(F.broadcast(first), "rule").withColumn("_slot", F.floor((F.col("t") - F.col("_t0")) / F.col("w")))
    slots = slotted.groupBy("rule", "_slot").agg(F.count("*").alias("_c"), F.first("_n").alias("_m"), F.first("w").alias("_w")).join(F.broadcast(runs), "rule")
    order = Window.partitionBy("run").orderBy(digest("slot", F.col("seed"), F.col("_slot")), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("_c").over(order), F.lit(0)) < F.greatest(F.lit(1), F.floor(F.col("_m") * F.col("fraction")))
    late = F.when(F.col("structure") != "delete", delay(F.col("_w"), F.col("multiple"), F.col("seed"), F.lit(None)))
    slots = slots.withColumn("_taken", taken).where("_taken").groupBy("rule", "_slot").agg(F.collect_list(F.struct("run", late.alias("delay"))).alias("moves"))
    rows = slotted.join(slots, ["rule", "_slot"], "left").drop("_t0", "_n", "_slot")
    rows = cut(rows.withColumn("moves", F.coalesce("moves", F.array().cast(NO_MOVES))), "moved")
    return rows, runs.join(F.broadcast(first.select("rule")), "rule", "left_semi")


def each_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` once per run of their rule that does not delete them, with ``run`` and ``arr``."""
    own = runs.groupBy("rule").agg(F.collect_list("run").alias("_runs"))  # a row per rule
    each = rows.join(F.broadcast(own), "rule").withColumn("run", F.explode("_runs")).drop("_runs")
    move = F.get(F.filter("moves", lambda x: x["run"] == F.col("run")), 0)
    each = each.withColumn("_m", move).where("_m IS NULL OR _m.delay IS NOT NULL")
    return each.withColumn("arr", F.col("t") + F.coalesce("_m.delay", F.lit(0))).drop("moves", "_m")


def edges(rows: DataFrame, each: DataFrame | None, runs: DataFrame, width, slices: int) -> DataFrame:
    """(place, rule, run, slice, last, first), place being a number for rule and slice: the last arrival before a slice of time (of ``each``, the rows that are moved, too), and
    the time of the first row after it that the run leaves in place; null if there is none. Least and largest of numbers are hashed;
    of structs they would sort each row once per run."""
    still = rows.join(F.broadcast(runs.groupBy("rule").agg(F.collect_set("run").alias("_runs"))), "rule")
    still = still.select("_s", "t", F.explode(F.array_except("_runs", "moves.run")).alias("run"))
    ends = still.groupBy("run", "_s").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    all_ = runs.select("rule", "run").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("_s", F.col("_s").cast("long"))
    all_ = all_.join(ends, ["run", "_s"], "left")
    if each is not None:
        came = each.groupBy("run", slice_number(F.col("arr"), width).alias("_s")).agg(F.max("arr").alias("_arr"))
        all_ = all_.join(came, ["run", "_s"], "left").withColumn("_last", F.greatest("_last", "_arr"))
    order = Window.partitionBy("run").orderBy("_s")
    last, first = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing))
    out = all_.select("rule", "run", F.col("_s").alias("slice"), last.alias("last"), first.alias("first"))
    return cut(out.withColumn("place", F.dense_rank().over(Window.orderBy("rule", "slice"))), "edges")  # a row per run and slice


#: Rows without moves have an empty list: Arrow's writer goes through all nulls of a list since the last value anew at each row.
NO_MOVES = "array<struct<run:int,delay:bigint>>"

VERDICT = pa.schema([("rule", pa.string()), ("key", pa.string()), ("t", pa.int64()), ("seq", pa.int64()), ("run", pa.int32()), ("p", pa.int64()), ("m", pa.int64())])


def verdicts(rows: DataFrame, runs: DataFrame, width, before: bool = False, only: Column | None = None, even: bool = False) -> DataFrame:
    """(rule, key, t, seq, run, p, m) of the rows that ``runs`` move (``only`` of some): m of those that are moved by
    more than W, if there is one, and p of all, if ``before``. ``even`` promises that a run moves its rows equally far.

    A slice of time gets its own rows, and of each run the last arrival before it and the first row in place after it. Rows that
    are moved equally far never overtake each other; where they are not, it also gets the rows up to that first one."""
    few = rows.select("rule", "key", "t", "seq", "w", "moves", (F.lit(True) if only is None else only).alias("_only")).withColumn("_s", slice_number(F.col("t"), width))
    each = few.where(F.lit(True) if before else F.col("_only")).select("rule", "key", "t", "seq", "w", "_only", F.explode("moves").alias("_m")).select("rule", "key", "t", "seq", "w", "_only", "_m.run", (F.col("t") + F.col("_m.delay")).alias("arr"))
    each = each.where("arr IS NOT NULL").join(F.broadcast(runs.select("run")), "run", "left_semi").withColumns({"x": F.col("t") + F.col("w"), "moves": F.array().cast(NO_MOVES)})
    slices = 1 if width is None else len(width) + 1
    if slices == 1:
        ends, near = None, runs.select("rule").distinct().select(F.row_number().over(Window.orderBy("rule")).alias("place"), "rule", F.lit(0).cast("long").alias("slice"), F.lit(LEAST).alias("hi"))
    else:
        ends = edges(few, each if before else None, runs, width, slices)
        hi = F.lit(LEAST) if even else F.max(F.coalesce("first", F.lit(MOST)))
        near = ends.groupBy("place", "rule", "slice").agg(hi.alias("hi"))
    near = cut(near, "near")  # a row per rule and slice; one number for both, as rows are sorted by it
    # the slices of time that a slice reaches to: a row is held against those few, not against all slices
    last = F.greatest("slice", slice_number(F.col("hi"), width))
    reached, near = F.broadcast(near.withColumn("_s", F.explode(F.sequence("slice", last)))), F.broadcast(near)
    none, key = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    base = few.join(reached, ["rule", "_s"]).where("_s = slice OR t <= hi").select("place", "rule", F.lit(0).alias("kind"), key.alias("key"), "t", "seq", F.lit(None).cast("int").alias("run"), none.alias("arr"), none.alias("x"), "moves")
    columns = ["place", "rule", "kind", "key", "t", "seq", "run", "arr", "x", "moves"]
    probes = each.where("_only AND arr > x").withColumns({"slice": slice_number(F.col("x"), width), "kind": F.lit(2)})
    out = base.union(probes.join(near, ["rule", "slice"]).select(*columns))
    if before:
        own = each.withColumns({"slice": slice_number(F.col("arr"), width), "kind": F.when(F.col("_only"), F.lit(1)).otherwise(F.lit(3))})
        out = out.union(own.join(near, ["rule", "slice"]).select(*columns))
    if ends is not None:
        at = lambda kind, t, seq: {"kind": F.lit(kind), "key": key, "t": t, "seq": seq, "arr": t, "x": F.lit(LEAST), "moves": F.array().cast(NO_MOVES)}
        if before:
            out = out.union(ends.where("last IS NOT NULL").withColumns(at(3, F.col("last"), F.lit(LEAST))).select(*columns))
        if even:
            heads = few.select("rule", F.col("t").alias("first"), "seq", "moves").join(F.broadcast(ends.select("place", "rule", "run", "first")), ["rule", "first"])
            heads = heads.where(~F.array_contains("moves.run", F.col("run"))).groupBy("place", "rule", "run", "first").agg(F.min("seq").alias("seq"))
            out = out.union(heads.withColumns(at(4, F.col("first"), F.col("seq"))).select(*columns))
    dealt = out.repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(_look_up, "rule string, key string, t bigint, seq bigint, run int, p bigint, m bigint")


def _look_up(batches) -> Iterator[pa.RecordBatch]:
    """Slice by slice, of batches sorted by ``place``."""
    parts: list[pa.RecordBatch] = []
    for new, part in detect.groups(batches, ["place"]):
        if new and parts:
            yield from _looked_up(pa.Table.from_batches(parts)).to_batches(10_000)
            parts = []
        parts.append(part)
    if parts:
        yield from _looked_up(pa.Table.from_batches(parts)).to_batches(10_000)


def pairs(moves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, run, delay) of a column of moves, by run; -1 where a row is deleted."""
    moves = moves.combine_chunks() if isinstance(moves, pa.ChunkedArray) else moves
    flat, lengths = moves.flatten(), np.diff(moves.offsets.to_numpy())
    run, delay = flat.field("run").to_numpy(), pc.fill_null(flat.field("delay"), -1).to_numpy()
    order = np.argsort(run, kind="stable")
    return np.repeat(np.arange(len(moves)), lengths)[order], run[order], delay[order]


def of_run(sorted_runs: np.ndarray, run: int) -> slice:
    return slice(*np.searchsorted(sorted_runs, [run, run + 1]))


def _looked_up(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    base = table.filter(pa.array(kind == 0))
    base = base.take(pa.array(np.lexsort((base.column("seq").to_numpy(), base.column("t").to_numpy()))))
    t, seq = base.column("t").to_numpy(), base.column("seq").to_numpy()
    row, run, delay = pairs(base.column("moves"))
    asked = table.filter(pa.array(kind > 0)).drop_columns(["moves"])
    if not asked.num_rows:
        return VERDICT.empty_table()
    of, kinds = asked.column("run").to_numpy(), asked.column("kind").to_numpy()
    at, num, occ, x = (asked.column(c).to_numpy() for c in ("arr", "seq", "t", "x"))
    p, m = np.full(len(of), MOST), np.full(len(of), MOST)
    by_run = np.argsort(of, kind="stable")
    for r in np.unique(of[kinds < 3]).tolist():
        own, mine = of_run(run, r), by_run[of_run(of[by_run], r)]
        after = mine[kinds[mine] == 4]  # the first row in place after the slice
        all_t, all_seq = np.append(t, occ[after]), np.append(seq, num[after])
        d, stays = np.zeros(len(all_t), np.int64), np.ones(len(all_t), bool)
        d[row[own]], stays[row[own]] = delay[own], False
        still = np.flatnonzero(stays)
        probes = mine[kinds[mine] == 2]
        m[probes] = _first_earlier(all_t, all_seq, all_t + d, d[~stays], still, occ[probes], x[probes], at[probes], num[probes])
        came = mine[(kinds[mine] == 1) | (kinds[mine] == 3)]
        came = came[np.lexsort((num[came], at[came]))]
        p[came] = _before(all_t[still], all_seq[still], at[came], num[came])
    good = np.where(kinds == 1, p > LEAST, (kinds == 2) & (m < MOST))
    value = lambda v, k: pa.array(v[good], pa.int64(), mask=kinds[good] != k)
    kept = asked.filter(pa.array(good))
    return pa.Table.from_arrays([*(kept.column(c) for c in ("rule", "key", "t", "seq", "run")), value(p, 1), value(m, 2)], schema=VERDICT)


def _first_earlier(t, seq, arr, delays, still, occ, x, at, num) -> np.ndarray:
    """For each probe, the first event time above x that arrives before (at, num); MOST if there is none."""
    out, i, left = np.full(len(x), MOST), np.searchsorted(t, x, "right"), np.arange(len(x))
    if len(np.unique(np.concatenate([delays, at - occ]))) <= 1:  # rows that are moved as far never overtake
        i = np.append(still, len(t))[np.searchsorted(still, i)]
    while len(left):
        left = left[i[left] < len(t)]
        left = left[t[i[left]] <= at[left]]  # nothing arrives before it occurs
        here = i[left]
        early = (arr[here] < at[left]) | ((arr[here] == at[left]) & (seq[here] < num[left]))
        out[left[early]] = t[here[early]]
        left = left[~early]
        i[left] += 1
    return out


def _before(t, seq, at, num) -> np.ndarray:
    """The arrival before each of (at, num), which are in order: one of those, or of the rows (t, seq) in place; LEAST if there is none."""
    i = np.searchsorted(t, at, "left")
    tied = np.append(t, MOST)[i] == at
    tied &= np.append(seq, MOST)[i] < num
    still = np.where(tied, at, np.append(LEAST, t)[i])
    return np.maximum(still, np.append(LEAST, at)[: len(at)])


@dataclass(frozen=True)
class Cell:
    """What is evaluated: a run (none: the stream as it is), behind a buffer of so many microseconds or none.
    ``moving`` rows arrive out of order; with ``arrivals`` the rule sees times of arrival."""

    cell: int
    run: int | None
    w: int
    n: int
    buffer: int = 0
    moving: bool = False
    arrivals: bool = False


FOUND = pa.schema([("cell", pa.int32()), ("key", pa.string()), *((c, pa.int64()) for c in ("alerts", "rows", "dropped", "longest", "keys", "known"))])
FOUND_SQL = "cell int, key string, alerts bigint, rows bigint, dropped bigint, longest bigint, keys bigint, known bigint"
#: What keys are listed: those that a cell detects, those that the undistorted stream detects and the cell does not, or none.
DETECTED, LOST, NONE = "detected", "lost", "none"


def evaluated(rows: DataFrame, found: DataFrame | None, cells: dict[str, list[Cell]], with_alerts: bool, hot: DataFrame | None = None, listed: str = DETECTED) -> DataFrame:
    """(cell, key, alerts) of the keys that a cell detects, and rows without a key whose (rows, dropped, longest, keys, known,
    alerts) sum up to the cell's rows, those dropped as late, the keys detected, those of them that the undistorted stream of the
    rule detects too, and their alerts; the largest ``longest`` is its longest delay. ``found`` are the rows of
    ``verdicts``. ``alerts`` is null unless asked for; then detected is what has one. ``hot`` (rule, key) are keys that one
    task should not get. All cells of a rule meet a key at once, so what is only counted is summed there: a list of keys has
    a row for each key and cell (``listed``)."""
    base = rows.select("rule", "key", "t", "seq", "moves", F.lit(None).cast("int").alias("run"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("m"))
    if found is not None:
        base = base.union(found.select("rule", "key", "t", "seq", F.array().cast(NO_MOVES), "run", "p", "m"))
    few = base if hot is None else base.join(F.broadcast(hot.select("rule", "key")), ["rule", "key"], "left_anti")
    order = ["_g", "rule", "key", "t", "seq", "run"]  # a number first: most comparisons end there
    dealt = few.withColumn("_g", F.xxhash64("rule", "key")).repartition("rule", "key").sortWithinPartitions(*order).drop("_g")
    out = dealt.mapInArrow(_evaluate(cells, with_alerts, listed), FOUND_SQL)
    return out if hot is None else out.union(_evaluated_hot(rows, found, cells, with_alerts, hot, listed))


def whole_keys(batches) -> Iterator[pa.Table]:
    """Tables of whole keys, from batches sorted by rule and key."""
    parts, size, most = [], 0, CHUNK_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        size += batch.num_rows
        if size >= most:
            table = pa.Table.from_batches(parts)
            last = table.slice(size - 1)
            same = pc.and_(pc.equal(table.column("key"), last.column("key")[0]), pc.equal(table.column("rule"), last.column("rule")[0]))
            begin = int(np.argmax(same.to_numpy()))
            if begin:
                yield table.slice(0, begin)
            rest = table.slice(begin)
            parts, size = rest.to_batches(), rest.num_rows
            most = max(CHUNK_ROWS, 2 * size)
    if parts:
        yield pa.Table.from_batches(parts)


def _evaluate(cells: dict[str, list[Cell]], with_alerts: bool, listed: str):
    def run(batches):
        for table in whole_keys(batches):
            rule = table.column("rule").combine_chunks().dictionary_encode()
            codes = rule.indices.to_numpy()
            for k, name in enumerate(rule.dictionary.to_pylist()):
                yield from _evaluate_rule(table.filter(pa.array(codes == k)), cells.get(name, []), with_alerts, listed)

    return run


def _evaluate_rule(table: pa.Table, cells: list[Cell], with_alerts: bool, listed: str) -> Iterator[pa.RecordBatch]:
    is_base = pc.is_null(table.column("run")).to_numpy()
    base, told = table.filter(pa.array(is_base)), table.filter(pa.array(~is_base))
    key = base.column("key").combine_chunks().dictionary_encode()
    code, names = key.indices.to_numpy(), key.dictionary
    t, seq = base.column("t").to_numpy(), base.column("seq").to_numpy()
    row, run, delay = pairs(base.column("moves"))
    owner, of = (np.cumsum(is_base) - 1)[~is_base], told.column("run").to_numpy()
    by_run = np.argsort(of, kind="stable")
    of, owner = of[by_run], owner[by_run]
    p, m = (pc.fill_null(told.column(c), none).to_numpy()[by_run] for c, none in (("p", LEAST), ("m", MOST)))
    totals, known = [], np.zeros(len(names), bool)
    for c in sorted(cells, key=lambda c: c.run is not None):  # the undistorted stream first
        kept, arr, late = np.ones(len(t), bool), t, 0
        before = least = None
        longest = 0
        if c.run is not None:
            own, told_own = of_run(run, c.run), of_run(of, c.run)
            gone = delay[own] < 0
            kept[row[own][gone]] = False
            arr = t.copy()
            arr[row[own]] += np.maximum(delay[own], 0)
            longest = max(0, int(delay[own].max(initial=0)))
            before, least = np.full(len(t), LEAST), np.full(len(t), MOST)
            np.maximum.at(before, owner[told_own], p[told_own])
            np.minimum.at(least, owner[told_own], m[told_own])
            all_rows = int(kept.sum())
            if c.moving:
                kept &= ~(least < MOST if c.buffer == 0 else (least < MOST) & (least <= before - c.buffer))
            late = all_rows - int(kept.sum())
        else:
            all_rows = len(t)
        occ, idx = (arr if c.arrivals else t), np.flatnonzero(kept)
        if c.arrivals:
            idx = idx[np.lexsort((seq[idx], arr[idx], code[idx]))]
        own_key, times = code[idx], occ[idx]
        hit = np.flatnonzero((own_key[c.n - 1 :] == own_key[: len(idx) - c.n + 1]) & (times[c.n - 1 :] - times[: len(idx) - c.n + 1] <= c.w)) if len(idx) >= c.n else np.array([], int)
        got, counts = np.zeros(0, np.int64), np.zeros(0, np.int64) if with_alerts else None
        if len(hit) and not with_alerts:
            got = np.unique(own_key[hit])
        elif len(hit):
            # only rows of some span with n matter to the fold
            near = np.cumsum(np.bincount(hit, minlength=len(idx) + 1) - np.bincount(hit + c.n, minlength=len(idx) + 1)[: len(idx) + 1])[: len(idx)] > 0
            idx = idx[near]
            if c.moving and not c.arrivals:
                if c.buffer == 0:
                    idx = idx[np.lexsort((seq[idx], arr[idx], code[idx]))]
                else:
                    by_self = before[idx] >= t[idx] + c.buffer
                    place = np.where(by_self, before[idx], t[idx] + c.buffer)
                    idx = idx[np.lexsort((seq[idx], arr[idx], by_self, place, code[idx]))]
            got, counts = detect.alert_counts(code[idx], occ[idx], c.w, c.n)
        own_found = np.zeros(len(names), bool)
        own_found[got] = True
        if c.run is None:
            known = own_found
        totals.append((c.cell, None, int(counts.sum()) if with_alerts else None, all_rows, late, longest, len(got), int((own_found & known).sum())))
        if listed == DETECTED and len(got):
            yield _found(c.cell, names.take(pa.array(got)), counts)
        elif listed == LOST and (known & ~own_found).any():
            yield _found(c.cell, names.take(pa.array(np.flatnonzero(known & ~own_found))), None)
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*totals), FOUND)], schema=FOUND)


def _found(cell: int, keys: pa.Array, alerts: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), cell, np.int32)), keys, none if alerts is None else pa.array(alerts, pa.int64()), none, none, none, none, none], schema=FOUND)


def _evaluated_hot(rows: DataFrame, found: DataFrame | None, cells: dict[str, list[Cell]], with_alerts: bool, hot: DataFrame, listed: str) -> DataFrame:
    """The same for hot keys, each run's rows by themselves: what is folded is cut in slices there."""
    spark, all_ = rows.sparkSession, [(r, c) for r, own in cells.items() for c in own]
    grid = spark.createDataFrame([(r, c.cell, c.run, c.w, c.n, c.buffer, c.moving, c.arrivals) for r, c in all_], "rule string, cell int, of int, w bigint, n int, buffer bigint, moving boolean, arrivals boolean")
    few = rows.select("rule", "key", "t", "seq", "moves").join(F.broadcast(hot.select("rule", "key")), ["rule", "key"], "left_semi").join(F.broadcast(grid), "rule")
    move = F.get(F.filter("moves", lambda x: x["run"] == F.col("of")), 0)
    few = few.withColumn("_m", move).where("_m IS NULL OR _m.delay IS NOT NULL").withColumn("arr", F.col("t") + F.coalesce("_m.delay", F.lit(0))).drop("moves", "_m")
    few = few.withColumn("occ", F.when(F.col("arrivals"), F.col("arr")).otherwise(F.col("t")))
    if found is None:
        few = few.withColumns({"p": F.lit(LEAST), "m": F.lit(MOST)})
    else:
        told = found.join(F.broadcast(hot.select("rule", "key")), ["rule", "key"], "left_semi").groupBy(F.col("run").alias("of"), "seq").agg(F.max("p").alias("p"), F.min("m").alias("m"))
        few = few.join(told, ["of", "seq"], "left").na.fill({"p": LEAST, "m": MOST})
    late = F.col("moving") & (F.col("m") < MOST) & ((F.col("buffer") == 0) | (F.col("m") <= F.col("p") - F.col("buffer")))
    by_self = (F.col("buffer") > 0) & (F.col("p") >= F.col("t") + F.col("buffer"))
    place = F.when(~F.col("moving") | (F.col("buffer") == 0), F.col("arr")).when(by_self, F.col("p")).otherwise(F.col("t") + F.col("buffer"))
    few = cut(few.withColumns({"late": late, "place": place, "by_self": by_self.cast("int")}).withColumnRenamed("cell", "run"), "hot")
    kept = few.where("NOT late").select("run", "key", "arr", "seq", "occ", "w", "n", "place", "by_self", "moving")
    many = hot.select("rule", "key", "width").join(F.broadcast(grid.select("rule", F.col("cell").alias("run"))), "rule").drop("rule")
    n = sorted({c.n for _, c in all_})
    if with_alerts:
        seen = ["run", "key", "arr", "seq", "occ", "w", "n"]
        got = detect.alerts(kept.where("moving"), order=["place", "by_self", "arr", "seq"], hot=many).select("run", "key")
        got = got.union(detect.alerts_in_order(kept.where("NOT moving").select(*seen), n, many).select("run", "key")).groupBy("run", "key").agg(F.count("*").alias("alerts"))
    else:
        got = detect.subjects(kept, n, many).select("run", "key", F.lit(None).cast("bigint").alias("alerts"))
    # a row per hot key and cell at most
    names, none = F.broadcast(grid.select("rule", F.col("cell").alias("run"))), F.lit(None).cast("bigint")
    own = cut(got.join(names, "run").withColumn("known", F.max(F.col("run") < 0).over(Window.partitionBy("rule", "key"))), "hot_keys")
    counts = own.groupBy("run").agg(F.sum("alerts").alias("alerts"), F.count("*").alias("keys"), F.count_if("known").alias("known"))
    sums = few.groupBy("run").agg(F.count("*").alias("rows"), F.count_if("late").alias("dropped"), F.max(F.col("arr") - F.col("t")).alias("longest"))
    sums = sums.join(counts, "run", "left").na.fill(0, ["keys", "known"] + ["alerts"] * with_alerts)
    sums = sums.select(F.col("run").alias("cell"), F.lit(None).cast("string").alias("key"), "alerts", "rows", "dropped", "longest", "keys", "known")
    if listed == NONE:
        return sums
    if listed == LOST:
        expected = own.where("run < 0").select("rule", "key").join(names, "rule").select("run", "key")
        own = expected.join(own.select("run", "key"), ["run", "key"], "left_anti").withColumn("alerts", none)
    return sums.union(own.select("run", "key", "alerts", none, none, none, none, none))
