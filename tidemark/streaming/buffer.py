"""The bounded reorder buffer over a stream.

A stream's held events are its state, in the order of occurrence and arrival. An arrival at A releases those of
occurrence A - B or earlier, so state is what arrived within B. What the end would release stays held
until ``idle_ms`` of processing time have passed without an arrival, if that is given.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``released`` is null for what the end releases; ``place`` is the order of release.
RELEASED = "stream int, arr bigint, seq bigint, occ bigint, released bigint, place bigint"


class Buffer(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "occ bigint, arr bigint, seq bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arr", "seq"])
        held = [tuple(int(v) for v in x) for x in self.held.get()] if self.held.exists() else []
        heapq.heapify(held)
        out = []
        for arr, seq, occ, size in frame[["arr", "seq", "occ", "buffer"]].itertuples(index=False):
            heapq.heappush(held, (occ, arr, seq))
            while held and held[0][0] <= arr - size:
                out.append((*heapq.heappop(held), arr))
        self.keep(held)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.numbered(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(tuple(int(v) for v in x) for x in self.held.get()) if self.held.exists() else []
        self.keep([])
        yield self.numbered(key, [(*x, None) for x in held])

    def keep(self, held: list[tuple[int, int, int]]) -> None:
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    def numbered(self, key, out: list[tuple]) -> pd.DataFrame:
        n = int(self.count.get()[0]) if self.count.exists() else 0
        if out:
            self.count.update((n + len(out),))
        made = [(key[0], arr, seq, occ, released, n + k) for k, (occ, arr, seq, released) in enumerate(out)]
        frame = pd.DataFrame(made, columns=["stream", "arr", "seq", "occ", "released", "place"])
        return frame.astype({"released": "Int64"})

    def close(self) -> None:
        pass


def buffered(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Releases of a stream of (stream, arr, seq, occ, buffer) in order of arrival, in microseconds.
    ``spark.sql.streaming.stateStore.providerClass`` has to be ``rule.STATE_STORE``."""
    return events.groupBy("stream").transformWithStateInPandas(Buffer(idle_ms), RELEASED, "append", "none" if idle_ms is None else "processingTime")
