"""The threshold rule over a stream, exact per event.

Two stateful steps in append mode: the first keeps the watermark of a whole stream and marks late
events, the second keeps the held times of each key and emits alerts. A built-in watermark moves
between micro-batches only and would drop fewer events. The first step is one key per stream, as
the rule's watermark is shared by all keys: give independent streams their own ``stream`` value. Where
one stream is too much for a task, see ``sharded``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.detect import fold

MARKED = "stream string, key string, arr bigint, seq bigint, occ bigint, late boolean"
ALERT = "stream string, key string, fired_at bigint, count int, window_start bigint, window_end bigint"
#: Both steps need this provider.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The session's state provider is STATE_STORE meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Lateness(StatefulProcessor):
    def __init__(self, w: int, allowed: int):
        self.w, self.allowed = w, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("watermark", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arr", "seq"])
        frame = frame[frame["key"].notna()]
        mark = self.mark.get()[0] if self.mark.exists() else None
        late = []
        for t in frame["occ"].tolist():
            late.append(mark is not None and t < mark - self.w - self.allowed)
            mark = t if mark is None else max(mark, t)
        if mark is not None:
            self.mark.update((int(mark),))
        yield frame[["stream", "key", "arr", "seq", "occ"]].assign(late=late)

    def close(self) -> None:
        pass


class Threshold(StatefulProcessor):
    """Held times too old for any later span are let go as newer ones come; those of a key that gets
    no more events, after ``idle_ms``."""

    def __init__(self, w: int, n: int, allowed: int, idle_ms: int | None):
        self.w, self.n, self.allowed, self.idle_ms = w, n, allowed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arr", "seq"])
        held = sorted(int(x[0]) for x in self.times.get()) if self.times.exists() else []
        times = frame.loc[~frame["late"], "occ"].tolist()
        out = [(key[0], key[1], *x) for x in fold(held, times, self.w, self.n, self.allowed)]
        held = [t for t in held if t >= held[-1] - 2 * self.w - self.allowed]
        if held:
            self.times.put([(t,) for t in held])
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["stream", "key", "fired_at", "count", "window_start", "window_end"])

    def close(self) -> None:
        pass


def alerts(events: DataFrame, window_us: int, threshold: int, allowed: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Alerts of a stream of (stream, key, arr, seq, occ); ``spark.sql.streaming.stateStore.providerClass``
    has to be STATE_STORE. A key is forgotten ``idle_ms`` of processing time after its last event: no
    less than W + ``allowed`` of the stream must pass meanwhile, else a verdict may change."""
    if threshold < 1 or window_us <= 0 or allowed < 0:
        raise ValueError("a rule needs a threshold of 1 or more, a window above 0 and a lateness of 0 or more")
    marked = events.groupBy("stream").transformWithStateInPandas(Lateness(window_us, allowed), MARKED, "append", "none")
    rule = Threshold(window_us, threshold, allowed, idle_ms)
    return marked.groupBy("stream", "key").transformWithStateInPandas(rule, ALERT, "append", "none" if idle_ms is None else "processingTime")
