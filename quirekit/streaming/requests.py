"""Streams of requests: waits that grow too long and answers that are kept (STM-06, STM-09).

Both keep state under a bound. A request's timers stand in event time, so they also go off for a key that falls silent,
as soon as other keys move the watermark. The cache is cut into shards by key; a shard holds at most ``entries`` keys and
drops the least recently used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirekit.streaming.chunks import DAY_MS

#: Longest wait for the next chunk, and longest time a request may take, in milliseconds.
STALL_MS, WALL_MS = 120_000, 180_000


class _Waits(StatefulProcessor):
    def __init__(self, stall_ms: int, wall_ms: int | None) -> None:
        self.stall_ms, self.wall_ms = stall_ms, wall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started bigint, last bigint, chunks bigint")

    def _due(self, started: int, last: int) -> tuple[int, str]:
        """When the request is given up if nothing more comes, and why."""
        stall = last + self.stall_ms
        if self.wall_ms is not None and started + self.wall_ms < stall:
            return started + self.wall_ms, "wall"
        return stall, "stall"

    def _end(self, started: int, last: int, chunks: int) -> tuple:
        return started, last, *self._due(started, last), chunks

    def _rows(self, key, ended: list[tuple]) -> Iterator[pd.DataFrame]:
        if ended:
            # Times are made column by column; one object for each would cost more than the rest of the work.
            started, last, at, kind, chunks = zip(*ended, strict=True)
            started, last, at = (np.array(ms, "datetime64[ms]").astype("datetime64[ns]") for ms in (started, last, at))
            yield pd.DataFrame({"key": key[0], "kind": kind, "started": started, "last": last, "at": at, "chunks": chunks})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for page in rows for t in page["at_ms"].tolist())
        started, last, chunks = self.open.get() or (None, None, 0)
        if started is not None:
            self.handle.deleteTimer(self._due(started, last)[0])
        ended = []
        for time in times:
            if started is not None and time >= self._due(started, last)[0]:
                ended.append(self._end(started, last, chunks))
                started = None
            if started is None:
                started, last, chunks = time, time, 0
            # A chunk that comes late is counted, but does not turn the clock back.
            last, chunks = max(last, time), chunks + 1
        if started is not None:
            self.open.update((started, last, chunks))
            self.handle.registerTimer(self._due(started, last)[0])
        yield from self._rows(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = []
        held = self.open.get()
        if held is not None:
            started, last, chunks = held
            if self._due(started, last)[0] <= expiredTimerInfo.getExpiryTimeInMs():
                ended.append(self._end(started, last, chunks))
                self.open.clear()
        yield from self._rows(key, ended)

    def close(self) -> None:
        pass


def given_up(events: DataFrame, key: str, time: str, late: str = "0 seconds", stall_ms: int = STALL_MS, wall_ms: int | None = WALL_MS) -> DataFrame:
    """STM-09: ``key, kind, started, last, at, chunks`` of each request that is given up, once the watermark shows it.

    A request begins with a key's first chunk. It is given up at ``last + stall_ms`` without a further chunk, or at
    ``started + wall_ms`` if that comes first; the key's next chunk begins another. State is one row for each open request
    and empties when its timer goes off.
    """
    named = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"))
    timed = named.withColumn("at_ms", F.unix_millis("time")).withWatermark("time", late)
    output = "key string, kind string, started timestamp, last timestamp, at timestamp, chunks bigint"
    return timed.groupBy("key").transformWithStateInPandas(_Waits(stall_ms, wall_ms), output, "Append", "EventTime")


class _Cache(StatefulProcessor):
    def __init__(self, entries: int, longest: int | None, idle_ms: int) -> None:
        self.entries, self.longest, self.idle_ms = entries, longest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Uses are numbered; a key's entry is its latest number, and ``order`` says which key a number stands for.
        # Numbers that are not a key's latest any more are passed over when the oldest is looked for.
        self.kept = handle.getMapState("kept", "key string", "used bigint", self.idle_ms)
        self.order = handle.getMapState("order", "used bigint", "key string", self.idle_ms)
        self.clock = handle.getValueState("clock", "next bigint, oldest bigint, held int", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("place", kind="stable")
        clock, oldest, held = self.clock.get() if self.clock.exists() else (0, 0, 0)
        hits, evicted = [], []
        for name, size in zip(asked["cache_key"], asked["size"], strict=True):
            hit = self.kept.containsKey((name,))
            dropped = 0
            if hit or ((self.longest is None or size <= self.longest) and size > 0):
                if hit:
                    self.order.removeKey((self.kept.getValue((name,))[0],))
                self.kept.updateValue((name,), (clock,))
                self.order.updateValue((clock,), (name,))
                clock, held = clock + 1, held + (not hit)
                while held > self.entries:
                    if self.order.containsKey((oldest,)):
                        self.kept.removeKey((self.order.getValue((oldest,))[0],))
                        self.order.removeKey((oldest,))
                        held, dropped = held - 1, dropped + 1
                    oldest += 1
            hits.append(bool(hit))
            evicted.append(dropped)
        self.clock.update((clock, oldest, held))
        yield pd.DataFrame({"place": asked["place"].to_numpy(), "cache_key": asked["cache_key"].to_numpy(), "hit": hits, "evicted": evicted})

    def close(self) -> None:
        pass


def cached(
    requests: DataFrame, place: Column, cache_key: Column, size: Column, shards: int = 64, entries: int = 3000, longest: int | None = None,
    idle_ms: int = DAY_MS, shard: Column | None = None,
) -> DataFrame:
    """STM-06: ``place, cache_key, hit, evicted`` of each request, in the order of ``place`` within a batch and shard.

    A key's shard is one of ``shards`` by its hash, or ``shard``, which must depend on the key alone.

    An answer is kept if its size is above 0 and at most ``longest``. A hit makes its key the latest used; an answer too
    many in a shard drops the least recently used. Only keys travel and stay in state, at most ``shards * entries``.
    """
    shard = F.pmod(F.xxhash64(cache_key), F.lit(shards)) if shard is None else shard
    asked = requests.select(shard.cast("string").alias("shard"), place.cast("bigint").alias("place"), cache_key.alias("cache_key"), size.cast("bigint").alias("size"))
    output = "place bigint, cache_key string, hit boolean, evicted bigint"
    return asked.groupBy("shard").transformWithStateInPandas(_Cache(entries, longest, idle_ms), output, "Append", "ProcessingTime")
