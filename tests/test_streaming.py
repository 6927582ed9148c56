from pyspark.sql import functions as F

from tidemark.operators import detect, reorder
from tidemark.streaming import buffer, rule, sharded

S = 1_000_000


def test_stream_equals_batch(spark, tmp_path):
    """One file per micro-batch; a late event must not wipe live state."""
    events = [(100, "a"), (110, "a"), (160, "b"), (100, "a"), (161, "b"), (120, "a"), (20, "a"), (170, "b"), (171, "b")]
    schema = "stream string, key string, arr bigint, seq bigint, occ bigint"
    rows = [("s", key, k, k, t * S) for k, (t, key) in enumerate(events)]
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rule.STATE_STORE)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = rule.alerts(stream, 60 * S, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.key, r.fired_at, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = spark.createDataFrame([(0, *r[1:]) for r in rows], "run int, key string, arr bigint, seq bigint, occ bigint").withColumns({"w": F.lit(60 * S).cast("long"), "n": F.lit(4)})
    expected = sorted((r.key, r.fired_at, r["count"]) for r in detect.alerts(detect.mark_late(batch).where("NOT late")).collect())
    assert got == expected and len(got) == 2


def batches_of(spark, rows, schema, folder, cuts):
    """Write the rows in parts, one after the other, and say when each is there."""
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).repartition(2).write.mode("append").parquet(folder)
        yield


def fold_streams(rows, allowed):
    """Alerts by stream, event by event, from rows in order of arrival."""
    marks, kept = {}, {}
    for stream, key, _, _, occ, w, n in rows:
        if key is None:
            continue
        mark = marks.get(stream)
        if mark is None or occ >= mark - w - allowed:
            marks[stream] = occ if mark is None else max(mark, occ)
            kept.setdefault((stream, key, w, n), []).append(occ)
    return sorted((s, k, *a) for (s, k, w, n), times in kept.items() for a in detect.fold([], times, w, n, allowed))


def test_sharded_stream(spark, tmp_path):
    """Several streams, micro-batches and slices; the queries start anew for each part."""
    import random

    rng, allowed = random.Random(8), 5 * S
    rows = []
    for stream in (0, 1, 2):
        w, n = (30 + 10 * stream) * S, 3 + stream
        rows += [(stream, rng.choice(["a", "b", None]), k * S, k, (k - rng.choice([0, 0, 0, 8, 60])) * S, w, n) for k in range(150)]
    rows.sort(key=lambda r: (r[2], r[0]))
    path = str(tmp_path)
    with rule.state_store(spark):
        for _ in batches_of(spark, rows, sharded.ROWS, f"{path}/in", [90, 91, 300]):
            sharded.mark_stream(spark.readStream.schema(sharded.ROWS).parquet(f"{path}/in"), path, f"{path}/cp", allowed).awaitTermination(180)
            query = sharded.held_alerts(sharded.marked_rows(spark, path), allowed).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp2").trigger(availableNow=True).start()
            query.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").select("stream", "key", "fired_at", "count", "window_start", "window_end").collect())
    assert got == fold_streams(rows, allowed) and len(got) > 10


def test_batches_are_marked_once(spark, tmp_path):
    rows = [(0, "a", k, k, k * S, S, 2) for k in range(40)]
    table = spark.createDataFrame(rows, sharded.ROWS)
    first, marks = sharded.mark_batch(table.where("arr < 20"), None, shards=5)
    second, after = sharded.mark_batch(table.where("arr >= 20").withColumn("occ", F.col("occ") - 30 * S), marks, shards=7)
    assert first.where("late").isEmpty() and {r.arr for r in second.where("late").collect()} == set(range(20, 40)) - {r for r in range(20, 40) if r - 30 >= 19 - 1 - 0}
    assert [tuple(r) for r in after.collect()] == [(0, 19 * S)]
    empty, none = sharded.mark_batch(table.where("false"), marks)
    assert empty.isEmpty() and none.collect() == marks.collect()
    assert not sharded.there(spark, str(tmp_path / "nothing"))


def test_state_goes_when_the_clock_passes(spark, tmp_path):
    """Keys that never fire are forgotten by event time, and no verdict changes."""
    w, rows, day = 10 * S, [], 1_700_000_000 * S
    for k in range(30):
        rows += [(0, f"k{k}", 3 * k, 3 * k, day + k * 7 * S, w, 2), (0, "z", 3 * k + 1, 3 * k + 1, day + k * 7 * S, w, 2), (0, "z", 3 * k + 2, 3 * k + 2, day + k * 7 * S + 1, w, 2)]
    rows += [(0, "z", 1000 + k, 1000 + k, day + 10_000 * S + k, w, 2) for k in range(2)] + [(0, "z", 2000 + k, 2000 + k, day + 20_000 * S + k, w, 2) for k in range(2)]
    path, sizes = str(tmp_path), []
    with rule.state_store(spark):
        for _ in batches_of(spark, rows, sharded.ROWS, f"{path}/in", [45, 90, 92]):
            sharded.mark_stream(spark.readStream.schema(sharded.ROWS).parquet(f"{path}/in"), path, f"{path}/cp").awaitTermination(180)
            query = sharded.held_alerts(sharded.marked_rows(spark, path), longest=w).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp2").trigger(availableNow=True).start()
            query.awaitTermination(180)
            sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").select("stream", "key", "fired_at", "count", "window_start", "window_end").collect())
    assert got == fold_streams(rows, 0) and len(got) == 32
    assert max(sizes) > 0 and sizes[-1] == 0, sizes


def test_buffer_over_a_stream(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for stream, size in enumerate((0, 40, 300)):
        made = sorted((t + rng.choice([0, 0, 50, 200]), t) for t in rng.sample(range(2000), 80))
        rows += [(stream, arr, k, occ, size) for k, (arr, occ) in enumerate(made)]
    rows.sort(key=lambda r: (r[1], r[0]))
    schema, path = "stream int, arr bigint, seq bigint, occ bigint, buffer bigint", str(tmp_path)
    with rule.state_store(spark):
        for _ in batches_of(spark, rows, schema, f"{path}/in", [70, 71, 180]):
            source = spark.readStream.schema(schema).parquet(f"{path}/in")
            buffer.buffered(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.parquet(f"{path}/out").collect()
    table = spark.createDataFrame(rows, schema).withColumnRenamed("stream", "run")
    wanted = reorder.released_order(reorder.buffered(table)).where("released IS NOT NULL").orderBy("run", *reorder.ORDER).collect()
    assert [(r.stream, r.seq, r.released) for r in sorted(got, key=lambda r: (r.stream, r.place))] == [(r.run, r.seq, r.released) for r in wanted]
    assert len(got) < len(rows)
