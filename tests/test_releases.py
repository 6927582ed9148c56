"""Buffers of all runs over one copy of the stream, from a table and from a stream."""

import numpy as np
from pyspark.sql import functions as F
from test_compact import shuffled

from tidemark.operators import compact, releases, reorder
from tidemark.plans import queries, sweeps
from tidemark.sources import events as ev
from tidemark.streaming import rule, sharded

S = 1_000_000
SIZES = {"dense_any": [0, 43_200 * S, 172_800 * S], "mid_cp": [86_400 * S, 0, 345_600 * S]}


def grid(spark, smoke):
    rules, options = queries.PID[:2], {"structures": ("random", "delete"), "fractions": (0.3,), "seeds": (0,), "multiples": (0.5, 1.0)}
    runs, rows = sweeps.moving(ev.table_events(spark, smoke), rules, **options)
    own = {}
    for r in runs.collect():
        own.setdefault(r.rule, []).append(r.run)
    return runs, rows, own


def one_by_one(spark, rows, runs):
    """What the buffer of a single stream releases, each run and size a stream of its own."""
    sizes = spark.createDataFrame([(r, k, b) for r, own in SIZES.items() for k, b in enumerate(own)], "rule string, size int, buffer bigint")
    each = compact.each_run(rows, runs).join(sizes, "rule").select((F.col("run") * 3 + F.col("size")).alias("run"), "arr", "seq", F.col("t").alias("occ"), "buffer")
    return sorted(tuple(r) for r in reorder.buffered(each, width=None).select((F.floor(F.col("run") / 3)).cast("int"), (F.col("run") % 3).cast("int"), "arr", "seq", "occ", F.coalesce("released", F.lit(-1))).collect())


def listed(found):
    return sorted(tuple(r) for r in found.na.fill(-1, ["released"]).collect())


def test_slices(spark, smoke):
    runs, rows, own = grid(spark, smoke)
    wanted = one_by_one(spark, rows, runs)
    days = np.array([queries.START + k * 43_200 * S for k in range(-10, 90, 3)])  # some slices have no arrival
    for width in (None, days):
        assert listed(releases.released(releases.arrived(rows), own, SIZES, width)) == wanted
    assert any(r[-1] == -1 for r in wanted) and any(r[-1] > r[2] for r in wanted)


def test_over_a_stream(spark, smoke, tmp_path, monkeypatch):
    """What a batch holds is released by a later one; slices are smaller than a batch."""
    runs, rows, own = grid(spark, smoke)
    path, plain = str(tmp_path), sharded.width_of
    monkeypatch.setattr(sharded, "width_of", lambda df, by, x: plain(df, by, x, most=200))
    for part in queries._in_parts(releases.arrived(rows), 3):
        part.write.mode("append").parquet(f"{path}/in")
        sharded.buffer_stream(spark.readStream.schema(releases.ARRIVED).parquet(f"{path}/in"), own, SIZES, path, f"{path}/checkpoint").awaitTermination(180)
    assert listed(sharded.buffer_releases(spark, path)) == one_by_one(spark, rows, runs)


def test_no_copy_per_run_and_size(spark, smoke):
    """36 buffers over 2.6 projected streams, each row shuffled a few times in all; and each different wait of 23 n rows."""
    n = ev.table_events(spark, smoke).count()
    for name, most in (("str06_buffer_checksums", 40), ("str06_stream_buffer", 40), ("str07_buffer_waits", 70)):
        assert shuffled(spark, lambda: queries.QUERIES[name](spark, smoke).collect()) < most * n, name  # noqa: B023


def test_keys_share_states(spark, tmp_path):
    """A thousand keys are held in a few states: a call for each key costs more than its fold."""
    rows = [(0, f"k{k % 1000}", k, k, k * S, 5000 * S, 4, False) for k in range(2500)]
    path = str(tmp_path)
    spark.createDataFrame(rows, sharded.MARKED).repartition(3).write.parquet(f"{path}/rows/batch=0")
    with rule.state_store(spark):
        query = sharded.held_alerts(sharded.marked_rows(spark, path), buckets=7).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(180)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 7
