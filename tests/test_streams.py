"""Streams against their batch forms: late and tied events, replays, restarts, live state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from discern.streaming import ordered, tabs
from discern.streaming.sink import ResultTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "tab_id long, client_ip string, ts timestamp, seq long, type string, url string, payload string"
FLUSH = T0 + dt.timedelta(days=2)


def events(seed, n):
    """Events of four tabs, many at the same time; urls come and go."""
    rng = random.Random(seed)
    at = [0.0] * 4
    out = []
    for i in range(n):
        k = rng.randrange(4)
        at[k] += rng.choice((0, 0, 0.2, 0.9, 0.901, 1.2, 2, 30))
        out.append((k, f"ip{k}", T0 + dt.timedelta(seconds=at[k]), i, rng.choice(("ready", "load", "mutation", "other", "heuristicResult")), rng.choice((None, None, "https://a", "https://b")), str(i)))
    return out


def fed(spark, path, batches):
    """A stream of files, a batch each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def shuffled(rows, seed):
    """Rows of a few seconds in another order, in four batches, and one event that lets the watermark pass all."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: (r[2] - T0).total_seconds() + rng.uniform(0, 20))
    k = len(rows) // 4
    return [rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k], rows[3 * k :], [(9, "flush", FLUSH, 10**6, "other", None, None)]]


def written(stream, path, name):
    run = stream.writeStream.format("parquet").option("path", f"{path}/{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/cp-{name}").start()
    assert run.awaitTermination(240)


def as_set(df):
    return sorted(map(tuple, df.collect()))


def test_quota_by_definition(spark):
    rows = events(1, 300) + [(None, None, T0, 400, None, None, None), (0, "ip0", None, 401, None, None, None)]
    got = as_set(ordered.quota(spark.createDataFrame(rows, SCHEMA).repartition(7), 3, 5_000_000))
    want, open_ = [], {}
    for r in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[3])):
        start, n = open_.get(r[1], (None, 0))
        if start is None or (r[2] - start).total_seconds() >= 5:
            start, n = r[2], 0
        open_[r[1]] = (start, n + 1)
        want.append((r[1], round((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), r[3], n + 1, n + 1 > 3))
    assert got == sorted(want)
    assert ordered.quota(spark.createDataFrame([], SCHEMA), 3, 5).collect() == []


def test_quota_stream_agrees_with_batch(spark, tmp_path):
    rows = events(2, 240)
    stream = ordered.quota_stream(fed(spark, tmp_path, shuffled(rows, 3)), 3, 5_000_000, late="2 minutes")
    written(stream, tmp_path, "quota")
    got = spark.read.schema("key string, us long, seq long, rank_in_window long, limited boolean").parquet(f"{tmp_path}/quota")
    assert as_set(got) == as_set(ordered.quota(spark.createDataFrame(rows, SCHEMA), 3, 5_000_000))


def test_analyses_stream_agrees_with_batch(spark, tmp_path):
    rows = events(4, 240)
    stream = ordered.analyses_stream(fed(spark, tmp_path, shuffled(rows, 5)), late="2 minutes")
    written(stream, tmp_path, "analyses")
    got = as_set(spark.read.schema("key string, due_us long, n long, immediate boolean").parquet(f"{tmp_path}/analyses"))
    want = tabs.analyses(spark.createDataFrame(rows, SCHEMA)).select(F.col("tab_id").cast("string"), "due_us", "n", "immediate")
    assert got == as_set(want) and len(got) > 50


CHANGE = "tab_id long, ts timestamp, seq long, payload string, removed boolean"


def table(spark, path):
    return ResultTable(spark, str(path), CHANGE, "tab_id", ("ts", "seq"), "removed")


def as_changes(df):
    known = tabs.changes(df).where(F.col("change").isin(tabs.RESULT, tabs.EVICT))
    return known.select("tab_id", "ts", "seq", "payload", (F.col("change") == tabs.EVICT).alias("removed"))


def tab_events(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(6), None, T0 + dt.timedelta(seconds=rng.randrange(40)), i, rng.choice(("heuristicResult", "heuristicResult", "removed", "loading")), rng.choice((None, "https://a")), f"p{i}") for i in range(n)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = tab_events(6, 60)
    parts = [spark.createDataFrame(rows[i : i + 20], SCHEMA) for i in (0, 20, 40)]
    results = table(spark, tmp_path / "t")
    assert results.read().collect() == []
    want = as_set(tabs.latest(spark.createDataFrame(rows, SCHEMA)).select("tab_id", "ts", "seq", "payload"))
    for k in (0, 1, 1, 2, 0, 2):
        results.write_batch(as_changes(parts[k]), k)
    assert as_set(results.read()) == want
    results.snapshot(1)
    results.snapshot(1)
    assert as_set(results.read()) == want
    results.write_batch(as_changes(parts[2]), 2)  # the batch after the snapshot is run again
    results.snapshot(2)
    assert as_set(results.read()) == as_set(table(spark, tmp_path / "t").read()) == want


def test_sink_goes_on_after_a_restart(spark, tmp_path):
    rows = tab_events(7, 80)
    results = table(spark, tmp_path / "t")
    failed = []

    def failing(changes, batch_id):
        results.sink(every=2)(changes, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the driver is lost after the write, before the commit")

    stream = as_changes(fed(spark, tmp_path, [rows[i : i + 20] for i in (0, 20, 40, 60)]))
    start = lambda: stream.writeStream.foreachBatch(failing).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    with pytest.raises(Exception):
        start().awaitTermination(120)
    assert failed == [1]
    assert start().awaitTermination(120)
    assert as_set(results.read()) == as_set(tabs.latest(spark.createDataFrame(rows, SCHEMA)).select("tab_id", "ts", "seq", "payload"))


def test_live_state_equals_the_latest_results(spark, tmp_path):
    rows = tab_events(8, 60)
    run = tabs.track(fed(spark, tmp_path, [rows[:30], rows[30:]])).writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert run.awaitTermination(120)
    state = tabs.held(spark, f"{tmp_path}/cp")
    want = tabs.latest(spark.createDataFrame(rows, SCHEMA))
    assert as_set(state) == as_set(want.select("tab_id", "ts", "payload"))
    asked = spark.createDataFrame([(k,) for k in range(9)], "tab_id long")
    assert as_set(tabs.lookup(state, asked).fillna("")) == as_set(tabs.lookup(want, asked).fillna(""))


def test_unchanged_pages_come_through_once(spark, tmp_path):
    from discern.streaming import scans

    page = "url string, html string, ts timestamp, note long"
    batches = [[("a", "x", T0, 1), ("a", "x", T0, 2), ("b", None, T0, 3)], [("a", "x", T0, 4), ("b", None, T0, 5), ("b", "", T0, 6), (None, "x", T0, 7)], [("a", "y", T0, 8), (None, "x", T0, 9)]]
    for rows in batches:
        spark.createDataFrame(rows, page).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(page).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    written(scans.unchanged_once(stream), tmp_path, "once")
    got = as_set(spark.read.parquet(f"{tmp_path}/once").select(F.coalesce("url", F.lit("-")), F.coalesce("html", F.lit("-"))))
    want = as_set(scans.unchanged_once(spark.read.schema(page).parquet(f"{tmp_path}/in")).select(F.coalesce("url", F.lit("-")), F.coalesce("html", F.lit("-"))))
    assert got == want == [("-", "x"), ("a", "x"), ("a", "y"), ("b", ""), ("b", "-")]


def test_answers_on_streams_agree_with_batch(spark, tmp_path):
    from discern.streaming import scans

    rows = events(9, 200)
    stream = fed(spark, tmp_path, shuffled(rows, 10))
    kinds = lambda df: (df.where("type = 'load'"), df.where("type = 'heuristicResult'"))
    written(scans.answered(*kinds(stream), "1 minute", "2 minutes"), tmp_path, "answers")
    got = as_set(spark.read.schema("tab_id long, asked_seq long, result_seq long, delay_us long").parquet(f"{tmp_path}/answers"))
    assert got == as_set(scans.answered(*kinds(spark.createDataFrame(rows, SCHEMA)), "1 minute")) and len(got) > 20


def test_equal_texts_are_asked_once_and_failures_again(spark, tmp_path):
    from discern.operators import requests

    texts = ["same"] * 30 + ["other", "fails twice", "fails twice", "fails for ever", None]
    df = spark.createDataFrame([(i, t, 200) for i, t in enumerate(texts)] + [(99, "same", 403)], "id long, text string, status int").repartition(5)

    def client(model):
        def ask(asked):
            import os
            import uuid

            kind = next(k for k in ("same", "other", "twice", "ever") if k in asked)
            open(f"{tmp_path}/{kind}-{uuid.uuid4().hex}", "w").close()
            if kind == "ever" or kind == "twice" and sum(f.startswith("twice") for f in os.listdir(tmp_path)) < 3:
                raise RuntimeError(kind)
            return f"reply to {kind}"

        return ask

    got = {r["id"]: (r["output"], r["status"], r["error"]) for r in requests.call_model(df.where("text is not null"), "id", client, attempts=4, pause=0.01).collect()}
    assert [got[i] for i in (0, 29, 30, 31, 32)] == [("reply to same", 200, None)] * 2 + [("reply to other", 200, None)] + [("reply to twice", 200, None)] * 2
    assert got[33] == (None, 500, "server_error") and set(got) == set(range(34))
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert {k: calls.count(k) for k in calls} == {"same": 1, "other": 1, "twice": 3, "ever": 4}
