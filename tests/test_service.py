import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from discern.operators import report, requests, risk
from discern.streaming import tabs

T0 = dt.datetime(2024, 1, 1)


def test_gates_in_order(spark):
    rows = [
        (1, True, "bad", "x"), (2, False, "bad", "x"), (3, False, None, "x"), (4, False, "ok", " \n "), (5, False, "ok", None),
        (6, False, "ok", "x" * 50_001), (7, False, "ok", "x" * 50_000),
    ]
    df = spark.createDataFrame(rows, "id long, limited boolean, token string, text string")
    got = [(r["status"], r["error"]) for r in requests.gate_analyze(df, "ok").orderBy("id").collect()]
    assert got == [(429, "rate_limited"), (401, "unauthorized"), (401, "unauthorized"), (400, "missing_text"), (400, "missing_text"), (413, "text_too_large"), (200, None)]
    closed = [r["status"] for r in requests.gate_analyze(df, "ok", enabled=False, has_key=False).orderBy("id").collect()]
    assert closed == [429, 401, 401, 403, 403, 403, 403]
    assert requests.gate_analyze(df, "ok", has_key=False).where("id = 7").first()["error"] == "missing_openai_api_key"


def test_rate_limit(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=i)) for i in range(25)] + [("b", T0)], "client_ip string, ts timestamp")
    rows = requests.limited(df)
    assert rows.where("limited").count() == 5 and rows.where("client_ip = 'b' and not limited").count() == 1
    assert requests.limited(df.withColumn("ts", F.col("ts") + F.expr("interval 45 seconds"))).where("limited").count() == 0  # two windows


@pytest.mark.parametrize("output, parsed", [('{"a":1}', '{"a":1}'), ('so: {"a":1} ok', '{"a":1}'), ('{"a":1} and {"b":2}', None), ("null", None), ("false", None), ("0", None), ('""', None), ("", None), ("[1,2]", "[1,2]"), ("1] , [2", None), ("no", None), ("} {", None)])
def test_salvage(spark, output, parsed):
    columns = requests.parsed_reply(F.col("o"))
    row = spark.createDataFrame([(output,)], "o string").select(columns["parsed"].alias("p"), columns["raw"].alias("r")).first()
    assert tuple(row) == (parsed, None if parsed else output)


def test_model_call(spark):
    df = spark.createDataFrame([(1, "x", 200), (2, "boom", 200), (3, "x", 403)], "id long, text string, status int")

    def client(model):
        assert model == requests.DEFAULT_MODEL

        def ask(text):
            if "boom" in text:
                raise RuntimeError
            return text[-1]

        return ask

    got = {r["id"]: (r["output"], r["status"], r["error"]) for r in requests.call_model(df, "id", client).collect()}
    assert got == {1: ("x", 200, None), 2: (None, 500, "server_error")}


def test_admin_limit(spark):
    df = spark.createDataFrame([("ip", T0 + dt.timedelta(milliseconds=i), "ok", True) for i in range(62)], "client_ip string, ts timestamp, token string, enabled boolean")
    assert Counter(r["status"] for r in requests.gate_admin(df, "ok").collect()) == {200: 60, 429: 2}


def test_resets_and_triggers(spark):
    df = spark.createDataFrame([(1, T0, 1, "ready", None, None), (1, T0 + dt.timedelta(milliseconds=500), 2, "mutation", None, None), (1, T0, 3, "loading", None, None), (1, T0, 4, "other", None, None)], SCHEMA)
    rows = tabs.triggers(df)
    assert sorted((r["seq"], (r["ts"] - T0).total_seconds(), r["immediate"]) for r in rows.collect()) == [(1, 0, True), (1, 1.2, False), (2, 0.5, False)]
    assert [r["n"] for r in tabs.debounced(rows.where("not immediate")).collect()] == [2]
    assert [(r["seq"], r["badge_text"], r["toolbar_title"]) for r in tabs.resets(df).collect()] == [(3, "", "Scanning...")]


def test_removed_tabs_are_cleared(spark, tmp_path):
    batches = [
        [(2, T0, 3, "heuristicResult", None, "b"), (2, T0 + dt.timedelta(seconds=5), 4, "removed", None, None), (3, T0, 5, "heuristicResult", None, "c")],
        [(7, T0 + dt.timedelta(hours=1), 6, "heuristicResult", None, "x")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = tabs.track(stream, "1 minute").writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        assert run.awaitTermination(120)
    state = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "cp"))
    assert sorted(r["key"]["tab_id"] for r in state.collect()) == [3, 7]


def test_client_and_dispatch(spark):
    df = spark.createDataFrame([(1, False, "t", "x"), (2, True, "", "x"), (3, True, "t", "x")], "id long, enabled boolean, token string, text string")
    assert [r["client_error"] is None for r in requests.gate_client(df).orderBy("id").collect()] == [False, False, True]
    replies = spark.createDataFrame([(200, "{}"), (500, "x"), (403, '{"error":"disabled"}'), (404, '{"error":""}')], "status int, body string")
    assert [r["reply_error"] for r in requests.client_reply(replies).collect()] == [None, "HTTP 500", "disabled", "HTTP 404"]
    kinds = spark.createDataFrame([("heuristicResult",), (None,), ("x",)], "type string")
    assert [r["handler"] for r in requests.dispatch(kinds).collect()] == ["store", "ignored", "ignored"]


EVENTS = [
    (1, T0, 1, "heuristicResult", None, "a"), (1, T0 + dt.timedelta(seconds=5), 2, "loading", None, None),
    (2, T0, 3, "heuristicResult", None, "b"), (2, T0 + dt.timedelta(seconds=5), 4, "loading", "https://x", None),
    (3, T0, 5, "heuristicResult", None, "c"), (3, T0, 6, "heuristicResult", None, "d"),
    (4, T0, 7, "removed", None, None),
]
SCHEMA = "tab_id long, ts timestamp, seq long, type string, url string, payload string"


def test_latest_and_evicted(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert {r["tab_id"]: r["payload"] for r in tabs.latest(df).collect()} == {1: "a", 3: "d"}
    assert {r["tab_id"] for r in tabs.evicted(df).collect()} == {2, 4}
    found = tabs.lookup(tabs.latest(df), spark.createDataFrame([(1,), (9,)], "tab_id long"))
    assert {r["tab_id"]: r["payload"] for r in found.collect()} == {1: "a", 9: None}


def test_streams_agree_with_batch(spark, tmp_path):
    batch = spark.createDataFrame(EVENTS, SCHEMA)
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run = tabs.track(stream).writeStream.format("memory").queryName("tracked").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    last = {r["tab_id"]: r["payload"] for r in spark.sql("select * from tracked").collect()}
    assert last == {1: "a", 2: None, 3: "d", 4: None}
    gaps = tabs.debounced(stream, "2 seconds", watermark="0 seconds").writeStream.format("memory").queryName("gaps").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    gaps.awaitTermination(120)
    closed = {tuple(r) for r in spark.sql("select tab_id, first_ts, n from gaps").collect()}
    want = {tuple(r) for r in tabs.debounced(batch, "2 seconds").select("tab_id", "first_ts", "n").collect()}
    assert closed and closed <= want  # the last run of the stream is still open


def test_debounce_boundary(spark):
    df = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(milliseconds=900)), (1, T0 + dt.timedelta(milliseconds=1801))], "tab_id long, ts timestamp")
    assert sorted(r["n"] for r in tabs.debounced(df).collect()) == [1, 2]


def test_normalising_foreign_results(spark):
    from discern.operators.findings import FINDING

    rows = spark.createDataFrame(
        [(1, [("sale", "t", "s", "likely", "high", None, ["e"], None, None)], None, {}, {}), (2, [], None, {"mystery": True, "location": True, "sensitive": False}, {"location": ["a", "b", "c", "d"]}), (3, None, None, None, None)],
        f"id long, findings {FINDING}, counted_risk_count int, data_collected map<string,boolean>, data_evidence map<string,array<string>>",
    )
    got = {r["id"]: r for r in risk.normalized(rows).withColumn("raw", risk.raw_risk(F.col("findings"))).collect()}
    assert got[1]["findings"][0]["count_as_risk"] and got[1]["counted_risk_count"] == 1
    assert got[1]["raw"] == pytest.approx(28 * 1.3 + 2)
    assert [(f["category"], f["source_key"], len(f["evidence"])) for f in got[2]["findings"]] == [("location", "location", 3), ("general", "mystery", 0)]
    assert got[3]["findings"] == [] and got[3]["counted_risk_count"] == 0


def test_reports_without_a_result(spark):
    rows = spark.sql("select 1L id, cast(null as boolean) is_likely_policy_page, cast(null as array<struct<title:string,summary:string,confidence:string,severity:string,evidence:array<string>,count_as_risk:boolean>>) findings, cast(null as map<string,boolean>) data_collected, cast(null as map<string,array<string>>) data_evidence, cast(null as string) best_policy_link, 0 risks, 0 high_risks, 0 medium_risks")
    assert report.findings_report(rows, "id").first()["title"] == "No meaningful privacy risks are available yet."
    assert report.reasons_report(rows, "id").first()["reason"] == "No meaningful risks are available yet."
    assert report.checklist(rows, "id").first()["label"].startswith("No clear privacy-related")
    status = report.page_status(rows).first()
    assert status["finder_status"] == "No page checked yet." and status["link_text"] == "No policy link found"


def test_reply_bodies(spark):
    rows = spark.createDataFrame(
        [(200, None, '{"a":1}', None), (200, None, None, 'no "json"'), (200, None, None, None), (401, "unauthorized", None, None), (429, "rate_limited", None, None)],
        "status int, error string, parsed string, raw string",
    )
    assert [r["body"] for r in requests.analyze_reply(rows).collect()] == [
        '{"ok":true,"result":{"a":1}}', '{"ok":true,"raw":"no \\"json\\""}', '{"ok":true,"raw":""}', '{"ok":false,"error":"unauthorized"}', '{"ok":false,"error":"rate_limited"}',
    ]
    rows = spark.createDataFrame([(200, None, True), (401, "unauthorized", None), (429, "rate_limited", None)], "status int, error string, set_enabled boolean")
    assert [r["body"] for r in requests.admin_reply(rows).collect()] == ['{"ok":true,"enabled":true}', '{"ok":false,"error":"unauthorized"}', "Too many requests, please try again later."]
    assert requests.status_reply(spark.sql("select cast(null as boolean) enabled")).first()["body"] == '{"enabled":false}'
    replies = requests.client_reply(requests.analyze_reply(spark.sql("select 403 status, 'disabled' error, cast(null as string) parsed, cast(null as string) raw"))).first()
    assert (replies["ok"], replies["reply_error"]) == (False, "disabled")
