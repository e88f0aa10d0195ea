"""Latest result of each tab, its eviction, and debounced events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules

RESULT, EVICT, RELOAD = "result", "evict", "reload"


def changes(events: DataFrame) -> DataFrame:
    """events (tab_id, ts, seq, type, url, payload) with change.

    A result replaces the tab's entry; closing a tab or loading another address
    removes it; loading without an address leaves it.
    """
    kind = F.col("type")
    evicts = (kind == "removed") | ((kind == "loading") & (F.coalesce("url", F.lit("")) != ""))
    return events.withColumn("change", F.when(kind == "heuristicResult", RESULT).when(evicts, EVICT).when(kind == "loading", RELOAD))


def latest(events: DataFrame) -> DataFrame:
    """(tab_id, ts, seq, payload) of each tab whose last change is a result; ties in ts go by seq.

    One pre-aggregated maximum for each tab, so a busy tab doesn't gather in a task.
    """
    real = changes(events).where(F.col("change").isin(RESULT, EVICT))
    last = real.groupBy("tab_id").agg(F.max_by(F.struct("ts", "seq", "change", "payload"), F.struct("ts", "seq")).alias("x"))
    return last.where(F.col("x.change") == RESULT).select("tab_id", "x.ts", "x.seq", "x.payload")


def evicted(events: DataFrame) -> DataFrame:
    """(tab_id, ts, seq) of each tab whose last change removed its entry."""
    real = changes(events).where(F.col("change").isin(RESULT, EVICT))
    last = real.groupBy("tab_id").agg(F.max_by(F.struct("ts", "seq", "change"), F.struct("ts", "seq")).alias("x"))
    return last.where(F.col("x.change") == EVICT).select("tab_id", "x.ts", "x.seq")


def resets(events: DataFrame) -> DataFrame:
    """(tab_id, ts, seq, badge_text, toolbar_title) of each load, with or without an address: what the toolbar shows until there is a result."""
    loads = events.where(F.col("type") == "loading")
    return loads.select("tab_id", "ts", "seq", F.lit("").alias("badge_text"), F.lit(rules.SCANNING).alias("toolbar_title"))


#: A page is looked at again so many milliseconds after it is ready, and so long after the last trigger.
RECHECK_MS, DEBOUNCE_MS = 1200, 900


def triggers(events: DataFrame) -> DataFrame:
    """(tab_id, ts, seq, immediate) of the analyses that events ask for: ready, load, mutation, address.

    A ready page is analysed at once, and is due again RECHECK_MS later; the others only
    ask for a debounced analysis. debounced() of those that aren't immediate tells when
    these run.
    """
    kinds = F.when(F.col("type") == "ready", F.array(F.lit(0), F.lit(RECHECK_MS))).when(F.col("type").isin("load", "mutation", "address"), F.array(F.lit(0)))
    rows = events.select("tab_id", "ts", "seq", "type", F.explode(kinds).alias("later"))
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + 1000 * F.col("later"))
    return rows.select("tab_id", at.alias("ts"), "seq", ((F.col("type") == "ready") & (F.col("later") == 0)).alias("immediate"))


def lookup(state: DataFrame, tabs: DataFrame) -> DataFrame:
    """tabs (tab_id) with the payload of their latest result, null without one."""
    return tabs.join(state.select("tab_id", "payload"), "tab_id", "left")


def debounced(events: DataFrame, gap: str = "900 milliseconds", by: str = "tab_id", watermark: str | None = None) -> DataFrame:
    """(by, first_ts, last_ts, n): events whose distance is at most the gap fire once, after the last; without a longest wait.

    On a stream, give a watermark: a run is emitted once it is closed.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    runs = rows.groupBy(by, F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return runs.drop("session_window")


def address_changes(events: DataFrame) -> DataFrame:
    """The events (tab_id, ts, seq, url) at which a tab's address differs from the one before."""
    from pyspark.sql import Window as W

    before = F.lag("url").over(W.partitionBy("tab_id").orderBy("ts", "seq"))
    return events.withColumn("before", before).where("before is not null and url is not null and url <> before").drop("before")


def analyses(events: DataFrame) -> DataFrame:
    """(tab_id, due_us, n, immediate): when a tab's events (tab_id, ts, seq, type, url) let it be analysed.

    At once when it is ready; and DEBOUNCE_MS after the last of a run of n triggers: load and
    mutation events, changes of address, and a look RECHECK_MS after ready.
    """
    plain = events.where(F.col("type").isin("ready", "load", "mutation"))
    moved = address_changes(events.where("url is not null")).withColumn("type", F.lit("address"))
    asked = triggers(plain.select("tab_id", "ts", "seq", "type").unionByName(moved.select("tab_id", "ts", "seq", "type")))
    runs = debounced(asked.where("not immediate"), f"{DEBOUNCE_MS} milliseconds")
    later = runs.select("tab_id", (F.unix_micros("last_ts") + 1000 * DEBOUNCE_MS).alias("due_us"), "n", F.lit(False).alias("immediate"))
    now = asked.where("immediate").select("tab_id", F.unix_micros("ts").alias("due_us"), F.lit(1).cast("long").alias("n"), "immediate")
    return now.unionByName(later)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(tab_id, ts, payload) of the tabs that have a result in the state of a stream of track(), after its last batch."""
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    return state.where("not value.removed").select("key.tab_id", "value.ts", "value.payload")


class TabState(StatefulProcessor):
    """Keeps a tab's latest result; emits its payload, or null when it is removed.

    A removal is remembered until the watermark passes it; nothing older can come any
    more then, and the tab's state is cleared.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "ts timestamp, seq long, payload string, removed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        real = pd.concat(frames) if frames else pd.DataFrame()
        if len(real):
            real = real[real["change"].isin([RESULT, EVICT])].sort_values(["ts", "seq"])
        if not len(real):
            return
        held = self._entry.get() if self._entry.exists() else None
        row = real.iloc[-1]
        if held is not None and (pd.Timestamp(held[0]), held[1]) > (row["ts"], row["seq"]):
            return  # it came late
        removed = row["change"] != RESULT
        payload = None if removed else row["payload"]
        self._entry.update((row["ts"].to_pydatetime(), int(row["seq"]), payload, removed))
        if removed:
            self._handle.registerTimer(int(row["ts"].timestamp() * 1000) + 1)
        yield pd.DataFrame({"tab_id": [key[0]], "ts": [row["ts"]], "payload": [payload]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a result may have come since
        if self._entry.exists() and self._entry.get()[3] and int(self._entry.get()[0].timestamp() * 1000) < expiredTimerInfo.getExpiryTimeInMs():
            self._entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def track(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of (tab_id, ts, payload) updates of a stream of events, which may come `late`; needs the RocksDB state store."""
    keyed = changes(events).select("tab_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "change", "payload").withWatermark("ts", late)
    return keyed.groupBy("tab_id").transformWithStateInPandas(TabState(), outputStructType="tab_id long, ts timestamp, payload string", outputMode="Update", timeMode="EventTime")
