"""Evaluating threshold rules over runs: lateness, detected subjects, alerts.

Rows have ``run``, ``key``, ``arr`` and ``seq`` (the order of arrival), ``occ`` (the event time), and
the rule's ``w`` and ``n``. Neither a run nor a key has to fit in a task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.slicing import AUTO, SLICE_ROWS, numbered, running
from tidemark.sources.scratch import cut as table_of

ORDER = ["arr", "seq"]


def mark_late(rows: DataFrame, allowed: int = 0, order: list[str] = ORDER, width=AUTO) -> DataFrame:
    """``rows`` with ``late``: the event time lies more than W + ``allowed`` microseconds before the
    watermark, which is the largest event time of the run's earlier arrivals (dropped rows never
    raise it). The running maximum is taken in slices of arrival time and carried over."""
    if allowed < 0:
        raise ValueError("allowed lateness is 0 or more")
    marked = running(rows, ["run"], order, order[0], F.max, "occ", "_mark", width)
    return marked.withColumn("late", F.coalesce(F.col("occ") < F.col("_mark") - F.col("w") - allowed, F.lit(False))).drop("_mark")


def hot_keys(rows: DataFrame, *by: str, most: int = SLICE_ROWS) -> DataFrame | None:
    """(by, key, width) of the keys with more rows than one task should get, and slices of time that
    they are cut to, which are W long at least; None if there are none. There are fewer than
    the rows divided by ``most``."""
    n = F.col("_n")
    sizes = rows.groupBy(*by, "key").agg(F.count("*").alias("_n"), F.min("occ").alias("_lo"), F.max("occ").alias("_hi"), F.max("w").alias("_w"))
    width = F.greatest(F.col("_w"), F.floor((F.col("_hi") - F.col("_lo")) / F.ceil(n / max(most, 1))) + 1)
    hot = table_of(sizes.where(n > most).select(*by, "key", width.alias("width")), "hot")
    return None if hot.isEmpty() else hot


def hits(rows: DataFrame, thresholds: list[int], hot=AUTO) -> DataFrame:
    """``rows`` (accepted ones) with ``hit``: this event is at least the n-th of its key within w.
    ``thresholds`` are the values that n takes. A hot key is cut in slices of time; each slice also
    reads the window before it, which is all that a row looks back on."""
    hot = hot_keys(rows, "run") if hot is AUTO else hot
    if hot is None:
        cut = rows.withColumns({"_own": F.lit(0), "_s": F.lit(0)})
    else:
        place = F.floor(F.col("occ") / F.col("width"))
        last = F.pmod("occ", "width") >= F.col("width") - F.col("w")
        found = rows.join(hot, ["run", "key"], "left")
        cut = found.withColumn("_own", F.coalesce(place, F.lit(0))).withColumn("_s", F.explode(F.when(last, F.array(place, place + 1)).otherwise(F.array("_own")))).drop("width")
    order = Window.partitionBy("run", "key", "_s").orderBy("occ", "seq")
    return cut.withColumn("hit", is_hit(thresholds, order)).where("_s = _own").drop("_s", "_own")


def nth_back(thresholds: list[int], order) -> Column:
    """The n-th latest event time, this row's included; null if there are fewer."""
    nth = F.raise_error(F.concat(F.lit("no threshold "), F.col("n").cast("string"))).cast("long")
    for n in sorted(set(thresholds), reverse=True):
        nth = F.when(F.col("n") == n, F.lag("occ", n - 1).over(order) if n > 1 else F.col("occ")).otherwise(nth)
    return nth


def is_hit(thresholds: list[int], order) -> Column:
    return F.coalesce(F.col("occ") - nth_back(thresholds, order) <= F.col("w"), F.lit(False))


def subjects(rows: DataFrame, thresholds: list[int], hot=AUTO) -> DataFrame:
    """(run, key, first_t): the keys that the accepted rows detect, and when they first do. Whether
    a key is detected does not depend on the order of arrival, nor on the reset after an alert."""
    return hits(rows, thresholds, hot).where("hit").groupBy("run", "key").agg(F.min("occ").alias("first_t"))


ALERTS = pa.schema([("run", pa.int32()), ("key", pa.string()), ("fired_at", pa.int64()), ("count", pa.int32()), ("window_start", pa.int64()), ("window_end", pa.int64())])
ALERT = "run int, key string, fired_at bigint, count int, window_start bigint, window_end bigint"
#: Held times from which on those too old for any later span are let go.
HELD = 64


def fired(held: list[int], times: list[int], w: int, n: int, allowed: int = 0) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """Add events of one key to its held times, which stay sorted. An alert is due when some span of
    length w that holds the event has n held times: (place in ``times``, (event, count, first, last time
    of the span with most, of equals the earliest)); then the key starts anew. A time more than 2 W + L
    before the latest is never part of a span again."""
    for at, t in enumerate(times):
        if not held or t >= held[-1]:
            held.append(t)
            k = len(held)
            if k >= n and held[k - n] >= t - w:
                a = bisect.bisect_left(held, t - w)
                alert = t, k - a, held[a], t
                held.clear()
                yield at, alert
        else:
            bisect.insort_right(held, t)
            first, end = bisect.bisect_left(held, t - w), bisect.bisect_right(held, t)
            if bisect.bisect_right(held, t + w) - first >= n:
                best, start = 0, 0
                for a in range(first, end):
                    size = bisect.bisect_right(held, held[a] + w) - a
                    if size > best:
                        best, start = size, a
                if best >= n:
                    alert = t, best, held[start], held[start + best - 1]
                    held.clear()
                    yield at, alert
        if len(held) > HELD and held[0] < held[-1] - 2 * w - allowed:
            del held[: bisect.bisect_left(held, held[-1] - 2 * w - allowed)]


def fold(held: list[int], times: list[int], w: int, n: int, allowed: int = 0) -> list[tuple[int, int, int, int]]:
    """The alerts of ``fired``."""
    return [alert for _, alert in fired(held, times, w, n, allowed)]


#: Stretches that go on side by side; fewer are followed one by one.
SIDE_BY_SIDE = 32


def alert_counts(code: np.ndarray, times: np.ndarray, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, alerts) of the keys that have one, for rows sorted by key (``code``, ascending) and then by arrival. A key falls into
    stretches where all that came before lies more than W before all that comes after: they do not depend on
    each other. In those that arrive in order a hit fires if n rows came since the last alert; the others are folded."""
    if not len(times):
        return code, np.zeros(0, np.int64)
    rank, rel = np.cumsum(np.append(0, code[1:] != code[:-1])), times - times.min()
    apart = int(rel.max()) + w + 1  # so that no key is within W of another
    if (int(rank[-1]) + 1) * apart < 1 << 62:
        at = rel + rank * apart
        begin = np.append(0, np.flatnonzero(np.minimum.accumulate(at[::-1])[::-1][1:] > np.maximum.accumulate(at)[:-1] + w) + 1)
        odd = np.zeros(len(begin), bool)
        odd[np.searchsorted(begin, np.flatnonzero(at[1:] < at[:-1]) + 1, "right") - 1] = True
    else:
        at, begin = rel, np.append(0, np.flatnonzero(rank[1:] != rank[:-1]) + 1)
        odd = np.ones(len(begin), bool)
    end, fires = np.append(begin[1:], len(times)), np.zeros(len(begin), np.int64)
    enough = end - begin >= n
    own = np.flatnonzero(enough & ~odd)
    hit = np.append(np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] <= w) + n - 1, len(at) + n) if len(own) else None
    place = begin[own] + n - 1  # the first row that may fire
    while len(own) > SIDE_BY_SIDE:
        first = hit[np.searchsorted(hit, place)]
        on = first < end[own]
        own, place = own[on], first[on] + n
        fires[own] += 1
    for k, p in zip(own.tolist(), place.tolist()):
        mine, j, found = hit[slice(*np.searchsorted(hit, [p, end[k]]))].tolist(), 0, 0
        while (j := bisect.bisect_left(mine, p, j)) < len(mine):
            found, p = found + 1, mine[j] + n
        fires[k] += found
    for k in np.flatnonzero(enough & odd).tolist():
        fires[k] = sum(1 for _ in fired([], times[begin[k] : end[k]].tolist(), w, n))
    sums, keys = np.bincount(rank[begin], fires).astype(np.int64), code[np.append(0, np.flatnonzero(rank[1:] != rank[:-1]) + 1)]
    return keys[sums > 0], sums[sums > 0]


def groups(batches, keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Runs of rows that agree in ``keys``, from batches sorted by them; the flag tells whether the run
    begins a new group or goes on with that of the batch before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            codes = column.dictionary_encode().indices.to_numpy() if pa.types.is_string(column.type) else column.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.append(0, np.flatnonzero(new)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            own = tuple(part.column(k)[0].as_py() for k in keys)
            yield own != last, part
            last = own


def _fold_partition(allowed: int):
    """Rows come sorted by run, key and arrival; only the current key's times are held."""
    def run(batches):
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, w, n = (batch.column(c).to_numpy() for c in ("run", "w", "n"))
            keys, times = batch.column("key").dictionary_encode(), batch.column("occ").to_pylist()
            at, names = keys.indices.to_numpy(), keys.dictionary.to_pylist()
            starts = np.append(0, np.flatnonzero((runs[1:] != runs[:-1]) | (at[1:] != at[:-1])) + 1).tolist()
            out = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                own = (int(runs[a]), names[at[a]])
                if own != current:
                    current, held = own, []
                out += [(*own, *x) for x in fold(held, times[a:b], int(w[a]), int(n[a]), allowed)]
            if out:
                yield as_alerts(out)

    return run


def as_alerts(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), ALERTS)], schema=ALERTS)


def without(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    return rows if hot is None else rows.join(hot.select("run", "key"), ["run", "key"], "left_anti")


def alerts(rows: DataFrame, allowed: int = 0, order: list[str] = ORDER, hot=AUTO, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The alerts of the accepted rows, in whatever order they arrive: a fold per key over partitions
    sorted by run, key and arrival, in the memory of one key's held times. Hot keys are folded in
    slices: see ``alerts_in_slices``."""
    hot = hot_keys(rows, "run") if hot is AUTO else hot
    few = without(rows, hot).select(*dict.fromkeys(["run", "key", *order, "occ", "w", "n"])).withColumn("_g", F.xxhash64("run", "key"))
    dealt = few.repartition("run", "key").sortWithinPartitions("_g", "run", "key", *order)  # a number first: most comparisons end there
    out = dealt.select("run", "key", "occ", "w", "n").mapInArrow(_fold_partition(allowed), ALERT)
    return out if hot is None else out.union(alerts_in_slices(rows, hot, allowed, order, slice_rows))


#: Neighbouring hits that are gathered to one list, so that lists of picks stay short while they grow.
CHUNK = 64


def in_order_blocks(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """(run, key, n, chunks) for each stretch of a key whose alerts depend on each other, of rows that arrive in order of
    event time. A hit fires if n rows came since the last alert. So a hit whose predecessor lies n rows
    or more before it fires for sure: a stretch begins there. Hits of neighbouring rows form a block (a, b): within
    it every n-th fires. ``chunks`` are lists of blocks; a block's ``at`` has its rows (place, time, first time)."""
    time = Window.partitionBy("run", "key").orderBy("occ", "seq")
    nth = nth_back(thresholds, time)
    hit = rows.select("run", "key", "n", "w", "occ", "seq", nth.alias("_first"), F.row_number().over(time).cast("long").alias("_i")).where(F.col("occ") - F.col("_first") <= F.col("w"))
    back = F.col("_i") - F.lag("_i").over(time)
    upto = time.rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumns({"_new": F.coalesce(back >= F.col("n"), F.lit(True)).cast("int"), "_apart": F.coalesce(back > 1, F.lit(True)).cast("int")})
    hit = hit.withColumns({"_stretch": F.sum("_new").over(upto), "_block": F.sum("_apart").over(upto)})
    by = ["run", "key", "n", "_stretch"]
    blocks = hit.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("_i", "occ", "_first"))).alias("at"))
    block = F.struct(F.element_at("at", 1)["_i"].alias("a"), F.element_at("at", -1)["_i"].alias("b"), "at")
    chunks = blocks.groupBy(*by, F.floor(F.col("_block") / CHUNK).alias("_chunk")).agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_chunk", "blocks"))).alias("chunks"))


def _after(free: Column, block: Column, n: Column) -> Column:
    """The first row that may fire after a block, if rows from ``free`` on may fire before it."""
    first = F.greatest(free, block["a"])
    return F.when(first > block["b"], free).otherwise(first + (F.floor((block["b"] - first) / n) + 1) * n)


def alerts_in_order(rows: DataFrame, thresholds: list[int], hot=AUTO, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The alerts of accepted rows that arrive in order of event time, without a fold by row: see
    ``in_order_blocks``. Which row may fire first is carried from chunk to chunk, then in each from block to block."""
    hot = hot_keys(rows, "run") if hot is AUTO else hot
    n, none = F.col("n").cast("long"), F.array().cast("array<bigint>")
    grown = lambda s, free: F.struct(free.alias("free"), F.concat(s["all"], F.array(s["free"])).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("free"), none.alias("all"))
    through = lambda free, chunk: F.aggregate(chunk["blocks"], free, lambda f, b: _after(f, b, n))
    entry = F.aggregate("chunks", start, lambda s, c: grown(s, through(s["free"], c)), lambda s: s["all"])
    chunks = in_order_blocks(without(rows, hot), thresholds).select("run", "key", "n", F.inline(F.arrays_zip("chunks", entry.alias("entry")))).select("run", "key", "n", "chunks.blocks", F.col("entry").alias("free"))
    inner = F.aggregate("blocks", F.struct(F.col("free").alias("free"), none.alias("all")), lambda s, b: grown(s, _after(s["free"], b, n)), lambda s: s["all"])
    blocks = chunks.select("run", "key", "n", F.inline(F.arrays_zip("blocks", inner.alias("free")))).select("run", "key", "n", "blocks.a", "blocks.b", "blocks.at", "free")
    first = F.greatest("free", "a")
    picks = blocks.where(first <= F.col("b")).select("run", "key", "n", F.explode(F.transform(F.sequence(first, F.col("b"), n), lambda i: F.get("at", (i - F.col("a")).cast("int")))).alias("p"))
    out = picks.select("run", "key", F.col("p.occ").alias("fired_at"), F.col("n").cast("int").alias("count"), F.col("p._first").alias("window_start"), F.col("p.occ").alias("window_end"))
    return out if hot is None else out.union(alerts_in_slices(rows, hot, 0, ORDER, slice_rows))


def lookback(w: int, n: int, allowed: int) -> int:
    """So many arrivals since a key's last alert are all that a later one can depend on: accepted ones
    lie within 3 W + 2 L, and no W has n of them."""
    return (5 + 2 * -(-allowed // w)) * n


def slice_map(pending: list[int], times: list[int], w: int, n: int, allowed: int) -> list[int]:
    """For each number of arrivals that may be pending when a slice begins (the last ones of ``pending``):
    how many are when it ends. After an alert none is pending, so two courses that fire at one
    arrival are one from there on."""
    most, after, out = lookback(w, n, allowed), {}, []
    for j in range(len(pending) + 1):
        held: list[int] = []
        if any(True for _ in fired(held, pending[len(pending) - j :], w, n, allowed)):
            break  # so many would have fired before
        own, left = [], None
        for at, _ in fired(held, times, w, n, allowed):
            if at in after:
                left = after[at]
                break
            own.append(at)
        if left is None:
            left = min(most, len(times) - 1 - own[-1] if own else j + len(times))
        after.update(dict.fromkeys(own, left))
        out.append(left)
    return out


def alerts_in_slices(rows: DataFrame, hot: DataFrame, allowed: int, order: list[str] = ORDER, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The alerts of hot keys. What a key holds is known from the number of arrivals since its last
    alert, so a slice of arrivals maps that number at its beginning to that at its end, for every number
    there can be (few: see ``lookback``). Slices are mapped side by side, the maps are followed from slice to
    slice, and then all slices are folded side by side from what is known to be pending."""
    few = rows.join(hot.select("run", "key"), ["run", "key"], "left_semi")
    few = numbered(few, ["run", "key"], order, order[0], "_at")
    reach = ((5 + 2 * F.ceil(F.lit(allowed) / F.col("w"))) * F.col("n")).cast("long")
    own, last = F.floor((F.col("_at") - 1) / slice_rows), F.floor((F.col("_at") - 1 + reach) / slice_rows)
    placed = few.select("run", "key", "occ", "w", "n", "_at", own.alias("_own"), F.explode(F.sequence(own, last)).alias("slice")).withColumn("look", F.col("_own") < F.col("slice"))
    by = ["run", "key", "slice"]
    sliced = table_of(placed.select(*by, "look", "occ", "w", "n", "_at").repartition(*by).sortWithinPartitions(*by, "_at"), "hot_slices")
    dealt = lambda df: df.repartition(*by).sortWithinPartitions(*by, "_at")

    def whole(batches):
        """(run, key, slice), times before, times, w, n and the columns of each slice."""
        parts: list = []
        for new, part in groups(batches, by):
            if new and parts:
                yield one(parts)
                parts = []
            parts.append(part)
        if parts:
            yield one(parts)

    def one(parts):
        t = pa.Table.from_batches(parts)
        first, look, occ = t.slice(0, 1).to_pylist()[0], t.column("look").to_numpy(), t.column("occ").to_numpy()
        return tuple(first[k] for k in by), occ[look].tolist(), occ[~look].tolist(), first["w"], first["n"], first

    def maps(batches):
        for key, before, times, w, n, _ in whole(batches):
            if times:
                yield pa.RecordBatch.from_pylist([dict(zip(by, key), left=slice_map(before, times, w, n, allowed))], MAPS)

    def follow(batches):
        pending = 0
        for new, part in groups(batches, ["run", "key"]):
            pending, out = 0 if new else pending, []
            for left in part.column("left").to_pylist():
                out.append(pending)
                pending = left[min(pending, len(left) - 1)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in by), pa.array(out, pa.int32())], names=[*by, "pending"])

    def refold(batches):
        for (run, key, _), before, times, w, n, first in whole(batches):
            held: list[int] = []
            fold(held, before[len(before) - min(first["pending"], len(before)) :], w, n, allowed)
            found = fold(held, times, w, n, allowed)
            if found:
                yield as_alerts([(run, key, *x) for x in found])

    mapped = dealt(sliced).mapInArrow(maps, "run int, key string, slice bigint, left array<int>")
    entries = mapped.repartition("run", "key").sortWithinPartitions(*by).mapInArrow(follow, "run int, key string, slice bigint, pending int")
    return dealt(sliced.join(table_of(entries, "entries"), by)).mapInArrow(refold, ALERT)


MAPS = pa.schema([("run", pa.int32()), ("key", pa.string()), ("slice", pa.int64()), ("left", pa.list_(pa.int32()))])


def summary(marked: DataFrame, thresholds: list[int], allowed: int = 0, with_alerts: bool = True, hot=AUTO) -> DataFrame:
    """(run, accepted, dropped_late, keys[, alerts]) of rows with ``late``."""
    counts = marked.groupBy("run").agg(F.count_if(~F.col("late")).alias("accepted"), F.count_if("late").alias("dropped_late"))
    kept = marked.where("NOT late")
    out = counts.join(count(subjects(kept, thresholds, hot), "keys"), "run", "left")
    if with_alerts:
        out = out.join(count(alerts(kept, allowed, hot=hot), "alerts"), "run", "left")
    return out.na.fill(0, ["keys"] + ["alerts"] * with_alerts)


def count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("run").agg(F.count("*").alias(name))

