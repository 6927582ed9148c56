"""The threshold rule over streams in which no step is one key a stream.

Two queries. The first marks late events: within a micro-batch the watermark is a prefix maximum over
slices of arrival, worked on side by side, and what is carried from batch to batch is one number a
stream. The second keeps the held times of each key. What is written for a batch is written once: a
batch that comes again after a failure finds it there.

    rows: stream, key, arr, seq, occ, w, n   (null keys are no subjects)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.slicing import running, width_of
from tidemark.operators import releases
from tidemark.operators.detect import fold
from tidemark.streaming.rule import ALERT

ROWS = "stream int, key string, arr bigint, seq bigint, occ bigint, w bigint, n int"
MARKED = ROWS + ", late boolean"
#: A batch has this many slices a stream at least, more if it has more rows.
SHARDS, SHARD_ROWS = 4, 500_000
#: States that the keys of a stream are dealt over.
BUCKETS = 64


def mark_batch(rows: DataFrame, carry: DataFrame | None, allowed: int = 0, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(rows with ``late``, (stream, mark) afterwards) of one batch. Dropped events never exceed the
    watermark, so that of all rows is that of the accepted ones."""
    rows = rows.where("key IS NOT NULL")
    n, lo, hi = rows.agg(F.count("*"), F.min("arr"), F.max("arr")).first()
    parts = max(shards, -(-n // SHARD_ROWS))
    width = max(1, (hi - lo) // parts + 1) if n else 1
    marked = running(rows, ["stream"], ["arr", "seq"], "arr", F.max, "occ", "_mark", width)
    marks = rows.groupBy("stream").agg(F.max("occ").alias("mark"))
    if carry is not None:
        marked = marked.join(carry, "stream", "left").withColumn("_mark", F.greatest("_mark", "mark")).drop("mark")
        marks = marks.union(carry.select("stream", "mark")).groupBy("stream").agg(F.max("mark").alias("mark"))
    late = F.coalesce(F.col("occ") < F.col("_mark") - F.col("w") - allowed, F.lit(False))
    return marked.withColumn("late", late).drop("_mark"), marks


def there(spark: SparkSession, path: str) -> bool:
    """Has a write to this folder come to its end?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def mark_stream(events: DataFrame, path: str, checkpoint: str, allowed: int = 0, shards: int = SHARDS, **trigger) -> StreamingQuery:
    """Marks the late events of a stream, batch by batch: rows at ``path``/rows, watermarks at
    ``path``/marks, each in a folder of the batch."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if there(spark, f"{path}/marks/batch={number}"):
            return
        before = f"{path}/marks/batch={number - 1}"
        carry = spark.read.schema("stream int, mark bigint").parquet(before) if number and there(spark, before) else None
        rows = rows.persist()
        marked, marks = mark_batch(rows, carry, allowed, shards)
        if not there(spark, f"{path}/rows/batch={number}"):
            marked.select("stream", "key", "arr", "seq", "occ", "w", "n", "late").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        marks.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def buffer_stream(arrived: DataFrame, runs: dict[str, list[int]], sizes: dict[str, list[int]], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reorder buffers of every run and size over a stream of ``releases.ARRIVED`` rows in order of arrival. Each batch is looked
    up in slices of time; what it releases is at ``path``/all/batch=k/held=false, what the buffers hold after it beside that."""
    def batch(rows: DataFrame, number: int) -> None:
        spark, out = rows.sparkSession, f"{path}/all/batch={number}"
        if there(spark, out):
            return
        before = f"{path}/all/batch={number - 1}"
        held = None
        if number:
            names = spark.createDataFrame([(r, name) for name, own in runs.items() for r in own], "run int, rule string")
            held = spark.read.schema(releases.OUT_SQL + ", held boolean").parquet(before).where("held").join(F.broadcast(names), "run")
        rows = rows.persist()
        found = releases.released(rows, runs, sizes, width_of(rows, ["rule"], "arr"), held)
        found.withColumn("held", F.col("released").isNull()).write.mode("overwrite").partitionBy("held").parquet(out)
        rows.unpersist()

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def buffer_releases(spark: SparkSession, path: str) -> DataFrame:
    """What all batches released, and, with ``released`` null, what is held after the last one."""
    last = 0
    while there(spark, f"{path}/all/batch={last}"):
        last += 1
    if not last:
        return spark.createDataFrame([], releases.OUT_SQL)
    rows = spark.read.schema(releases.OUT_SQL + ", batch int, held boolean").parquet(f"{path}/all")
    return rows.where((F.col("batch") < last) & (~F.col("held") | (F.col("batch") == last - 1))).drop("batch", "held")


def marked_rows(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The rows that ``mark_stream`` writes, as a stream: whole batches in their order."""
    reader = spark.readStream.schema(MARKED)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}/rows/*")


class Held(StatefulProcessor):
    """The held times of a bucket of keys. With ``clock``, a timer of event time lets a key's go once the clock has
    passed the last one by 2 W + L: no later event can share a span with them."""

    def __init__(self, allowed: int, clock: bool):
        self.allowed, self.clock = allowed, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "keys binary")

    def load(self) -> dict[str, tuple[int, list[int]]]:
        """By key: W and the held times."""
        if not self.state.exists():
            return {}
        table = pa.ipc.open_stream(bytes(self.state.get()[0])).read_all().to_pydict()
        return {k: (w, times) for k, w, times in zip(table["key"], table["w"], table["times"])}

    def keep(self, held: dict[str, tuple[int, list[int]]]) -> None:
        if self.clock:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if not held:
            self.state.clear()
            return
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w for w, _ in held.values()], pa.int64()), pa.array([x for _, x in held.values()], pa.list_(pa.int64()))], names=["key", "w", "times"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        self.state.update((sink.getvalue().to_pybytes(),))
        if self.clock:
            self.handle.registerTimer(min(self.end(*x) for x in held.values()))

    def end(self, w: int, times: list[int]) -> int:
        """Milliseconds of the clock from which a key's times are let go."""
        return (times[-1] + 2 * w + self.allowed) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, held, out = pd.concat(list(rows)), self.load(), []
        codes, names = pd.factorize(frame["key"])
        order = np.lexsort((frame["seq"].to_numpy(), frame["arr"].to_numpy(), codes))
        codes, kept = codes[order], ~frame["late"].to_numpy(bool)[order]
        occ, w, n = (frame[c].to_numpy()[order] for c in ("occ", "w", "n"))
        starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(codes)]):
            name, own = names[codes[a]], int(w[a])
            times = held.pop(name, (own, []))[1]
            out += [(key[0], name, *x) for x in fold(times, occ[a:b][kept[a:b]].tolist(), own, int(n[a]), self.allowed)]
            times = [t for t in times if t >= times[-1] - 2 * own - self.allowed]
            if times:
                held[name] = own, times
        self.keep(held)
        yield pd.DataFrame(out, columns=["stream", "key", "fired_at", "count", "window_start", "window_end"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.keep({k: x for k, x in self.load().items() if self.end(*x) > now})
        yield pd.DataFrame([], columns=["stream", "key", "fired_at", "count", "window_start", "window_end"])

    def close(self) -> None:
        pass


def held_alerts(marked: DataFrame, allowed: int = 0, longest: int | None = None, apart: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Alerts of a stream of marked rows. A stream's keys are dealt over ``buckets`` states, as a call for each key costs
    more than its fold; a checkpoint belongs to one number of them. ``spark.sql.streaming.stateStore.providerClass`` has to be
    ``rule.STATE_STORE``. With ``longest`` (the largest W of all rules, in microseconds), keys are
    forgotten by the clock of event time, which all streams of the query share: ``apart`` is how far
    their watermarks may lie apart; times lie after 1970. Without it every key is kept."""
    rule = Held(allowed, longest is not None)
    marked = marked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    if longest is None:
        return marked.groupBy("stream", "bucket").transformWithStateInPandas(rule, ALERT.replace("stream string", "stream int"), "append", "none")
    delay = (longest + allowed + apart) // 1000 + 2  # an event at the deadline is not late
    clocked = marked.withColumn("_at", F.timestamp_micros("occ")).withWatermark("_at", f"{delay} milliseconds")
    return clocked.groupBy("stream", "bucket").transformWithStateInPandas(rule, ALERT.replace("stream string", "stream int"), "append", "eventTime")
