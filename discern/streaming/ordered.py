"""Streams whose events are worked on in the order of their time, late ones included.

An event waits in its key's state until the watermark has passed it; a timer then hands
over all that are due, by time and number. What comes later than the watermark is
dropped, so results are those of a batch over all other events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .tabs import DEBOUNCE_MS, RECHECK_MS

WAITING = "us long, seq long, type string, url string"


class InOrder(StatefulProcessor):
    """Keeps events (us, seq, type, url) waiting; due() gets those that the watermark has passed, and says what they make."""

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for f in rows:
            new += zip(f["us"].tolist(), f["seq"].tolist(), f["type"].tolist(), f["url"].tolist())
        if new:
            self._waiting.appendList([(int(u), int(s), k, a if isinstance(a, str) else None) for u, s, k, a in new])
        for ms in sorted({int(u) // 1000 + 1 for u, *_ in new}):
            self._handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # all that is older is known
        held = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        due = sorted((r for r in held if r[0] < upto), key=lambda r: r[:2])
        later = [r for r in held if r[0] >= upto]
        if due:
            if later:
                self._waiting.put(later)
            else:
                self._waiting.clear()
        made = self.due(due, upto)
        if made:
            out = pd.DataFrame(made, columns=list(self.columns))
            out.insert(0, "key", key[0])
            yield out

    def due(self, events: list[tuple], upto: int) -> list[tuple]:
        """Rows of `columns` that events make; upto: microseconds before which all is known."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Quota(InOrder):
    """Counts requests in windows that start at a key's first request after the last window."""

    columns = ("us", "seq", "rank_in_window", "limited")

    def __init__(self, limit: int, window_us: int):
        self._limit, self._window = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._open = handle.getValueState("open", "start long, n long")

    def due(self, events: list[tuple], upto: int) -> list[tuple]:
        held = self._open.get() if self._open.exists() else None
        made, state = counted((e[0] for e in events), self._window, tuple(held) if held else None)
        if state and state[0] + self._window <= upto:
            self._open.clear()  # over, whatever comes
        elif state:
            self._open.update(state)
        return [(us, seq, n, n > self._limit) for (us, seq, *_), n in zip(events, made)]


def counted(times: Iterator[int], window: int, state: tuple[int, int] | None = None) -> tuple[list[int], tuple[int, int] | None]:
    """(rank of each time in its window, (start, n) of the last window), from times in order and the window that was open."""
    out = []
    for t in times:
        state = (state[0], state[1] + 1) if state and t < state[0] + window else (t, 1)
        out.append(state[1])
    return out, state


def _in_order(events: DataFrame, key: str, late: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if c in events.columns else F.lit(None).cast("string")
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("seq").cast("long").alias("seq"), text("type").alias("type"), text("url").alias("url"))
    return rows.where("key is not null and us is not null and seq is not null").withWatermark("ts", late)


def quota_stream(requests: DataFrame, limit: int, window_us: int, by: str = "client_ip", late: str = "1 minute") -> DataFrame:
    """A stream of (key string, us, seq, rank_in_window, limited) for a stream of requests (by, ts, seq); as quota() in batch. Needs the RocksDB state store.

    A request is answered once the watermark has passed it; requests without key, time or number are dropped.
    """
    rows = _in_order(requests, by, late).groupBy("key")
    return rows.transformWithStateInPandas(Quota(limit, window_us), outputStructType="key string, us long, seq long, rank_in_window long, limited boolean", outputMode="Append", timeMode="EventTime")


def quota(requests: DataFrame, limit: int, window_us: int, by: str = "client_ip") -> DataFrame:
    """requests (by, ts, seq) as (key string, us, seq, rank_in_window, limited), by windows that start at a key's first request and last window_us.

    The first request at or after a window's end starts the next. Each start depends on the one
    before, so a key's requests pass one task, but as a sorted stream: only the open window is held.
    Ties go by seq; requests without key, time or number are dropped.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            ranks: list[int] = []
            for k, part in f.groupby("key", sort=False):
                made, state = counted(part["us"].tolist(), window_us, state if k == key else None)
                key = k
                ranks += made
            yield pd.DataFrame({"key": f["key"], "us": f["us"], "seq": f["seq"], "rank_in_window": ranks, "limited": [n > limit for n in ranks]})

    rows = _in_order(requests, by, "0 seconds").select("key", "us", "seq")
    rows = rows.repartition("key").sortWithinPartitions("key", "us", "seq")
    return rows.mapInPandas(fold, "key string, us long, seq long, rank_in_window long, limited boolean")


class Analyses(InOrder):
    """Turns a tab's events into analyses: at once when it is ready, and once after each run of triggers.

    Triggers are load and mutation events, a first look at a new address, and a look RECHECK_MS after
    ready. A run ends when DEBOUNCE_MS have passed without another; a timer waits for that.
    """

    columns = ("due_us", "n", "immediate")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self._address = handle.getValueState("address", "url string")
        self._triggers = handle.getListState("triggers", "us long")

    def due(self, events: list[tuple], upto: int) -> list[tuple]:
        address = self._address.get()[0] if self._address.exists() else None
        triggers = [r[0] for r in self._triggers.get()] if self._triggers.exists() else []
        before, out = address, []
        for us, _, kind, url in events:
            if kind == "ready":
                out.append((us, 1, True))
                triggers.append(us + 1000 * RECHECK_MS)
            elif kind in ("load", "mutation"):
                triggers.append(us)
            if url is not None:
                if address is not None and url != address:
                    triggers.append(us)
                address = url
        if address != before:
            self._address.update((address,))
        runs: list[list[int]] = []
        for t in sorted(triggers):
            if runs and t - runs[-1][-1] <= 1000 * DEBOUNCE_MS:
                runs[-1].append(t)
            else:
                runs.append([t])
        left = []
        for run in runs:  # closed runs are followed by nothing that could still join them
            if run[-1] + 1000 * DEBOUNCE_MS < upto:
                out.append((run[-1] + 1000 * DEBOUNCE_MS, len(run), False))
            else:
                left += run
        if left:
            self._triggers.put([(t,) for t in left])
            self._handle.registerTimer((left[-1] + 1000 * DEBOUNCE_MS) // 1000 + 2)
        elif triggers:
            self._triggers.clear()
        return out


def analyses_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """A stream of (key string, due_us, n, immediate) for a stream of tab events (tab_id, ts, seq, type, url); as tabs.analyses() in batch. Needs the RocksDB state store."""
    rows = _in_order(events, "tab_id", late).groupBy("key")
    return rows.transformWithStateInPandas(Analyses(), outputStructType="key string, due_us long, n long, immediate boolean", outputMode="Append", timeMode="EventTime")
