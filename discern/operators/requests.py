"""The analysis service as transformations: dispatch, gates, rate limit, model call, replies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules

MOST_TEXT = 50_000
ANALYZE_LIMIT, ADMIN_LIMIT = 20, 60
REPLY = "summary string, data_collected array<string>, data_shared_with array<string>, user_rights array<string>, risk_flags array<string>, overall_risk string"
DEFAULT_MODEL = "gpt-4o-mini"


def dispatch(messages: DataFrame) -> DataFrame:
    """messages with the handler of each type ('ignored' for null or unknown types)."""
    kind = F.col("type")
    handler = (
        F.when(kind == "heuristicResult", "store").when(kind == "getHeuristic", "lookup").when(kind == "getStatus", "read_toggle").when(kind == "setStatus", "write_toggle").when(kind == "analyzePolicy", "analyze").otherwise("ignored")
    )
    return messages.withColumn("handler", handler)


def limited(requests: DataFrame, limit: int = ANALYZE_LIMIT, window: str = "1 minute", by: str = "client_ip", order: tuple[str, ...] = ()) -> DataFrame:
    """requests (by, ts, ...) with rank_in_window and limited: beyond the limit of its tumbling window.

    Windows are aligned to the clock; ties in ts go by `order`.
    """
    place = W.partitionBy(by, "slot").orderBy("ts", *order)
    rows = requests.withColumn("slot", F.window("ts", window)["start"])
    return rows.withColumn("rank_in_window", F.row_number().over(place)).withColumn("limited", F.col("rank_in_window") > limit).drop("slot")


def _gate(*steps: tuple[Column, int, str]) -> dict[str, Column]:
    status, error = F, F
    for when, code, what in steps:
        status, error = status.when(when, code), error.when(when, what)
    return {"status": status.otherwise(200), "error": error.otherwise(F.lit(None).cast("string"))}


def gate_analyze(requests: DataFrame, token: str, enabled: Column | bool = True, has_key: Column | bool = True) -> DataFrame:
    """requests (token, text, limited) with status and error (null: pass), by the first gate that closes.

    The limiter stands first, so refused tokens use up quota.
    """
    text = F.coalesce("text", F.lit(""))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return requests.withColumns(
        _gate(
            (F.col("limited"), 429, "rate_limited"),
            (F.coalesce("token", F.lit("")) != token, 401, "unauthorized"),
            (~lit(enabled), 403, "disabled"),
            (F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 400, "missing_text"),
            (F.length(text) > MOST_TEXT, 413, "text_too_large"),
            (~lit(has_key), 500, "missing_openai_api_key"),
        )
    )


def gate_admin(requests: DataFrame, token: str) -> DataFrame:
    """Requests to set the flag (token, enabled, limited) with status, error and the flag they set.

    Requests (client_ip, ts) that weren't limited before are, by ADMIN_LIMIT a minute.
    """
    requests = requests if "limited" in requests.columns else limited(requests, ADMIN_LIMIT)
    rows = requests.withColumns(_gate((F.col("limited"), 429, "rate_limited"), (F.coalesce("token", F.lit("")) != token, 401, "unauthorized")))
    return rows.withColumn("set_enabled", F.when(F.col("status") == 200, F.coalesce("enabled", F.lit(False))))


def gate_client(requests: DataFrame) -> DataFrame:
    """The caller's own checks (enabled, token): client_error, null if it may send; and the body to send."""
    error = F.when(~F.coalesce("enabled", F.lit(False)), rules.SAID_ANALYZER_IS_DISABLED_TURN_IT).when(F.coalesce("token", F.lit("")) == "", rules.SAID_MISSING_EXTENSION_TOKEN_PASTE_IT)
    return requests.withColumn("client_error", error).withColumn("body", F.when(F.col("client_error").isNull(), F.to_json(F.struct("text"))))


def client_reply(replies: DataFrame) -> DataFrame:
    """replies (status, body) with ok and reply_error, tolerant of bodies that aren't JSON."""
    ok = F.col("status").between(200, 299)
    said = F.nullif(F.get_json_object("body", "$.error"), F.lit(""))
    return replies.withColumns({"ok": ok, "reply_error": F.when(~ok, F.coalesce(said, F.concat(F.lit(rules.SAID_HTTP), F.col("status").cast("string"))))})


def prompt(text: Column) -> Column:
    """What a model is asked about a text."""
    return F.concat(
        F.lit("Analyse this privacy policy. Answer with one JSON object with the members summary (string), data_collected, data_shared_with, user_rights, risk_flags (arrays of strings) and overall_risk (low, medium or high).\n\nPolicy text:\n"),
        text,
    )


def offline_model(model: str) -> Callable[[str], str]:
    """A stand-in that needs no network: an empty, well-formed reply."""
    return lambda asked: '{"summary": "", "data_collected": [], "data_shared_with": [], "user_rights": [], "risk_flags": [], "overall_risk": "low"}'


def call_model(
    requests: DataFrame, key: str, client: Callable[[str], Callable[[str], str]] = offline_model, model: str = DEFAULT_MODEL, attempts: int = 1, pause: float = 0.5, at_once: int = 4
) -> DataFrame:
    """(key, output, status, error) of each request with status 200; key is a long column.

    Equal texts are asked once and the answer joined back; only digests of texts meet, so
    copies of a text aren't exchanged with it. `client` makes one caller of the model for each
    task, used by at most `at_once` threads. A call that raises is made again, up to `attempts`
    times in all, after a pause that doubles; if all fail, its requests get status 500, a
    server_error and null output.
    """

    def answer(ask: Callable[[str], str], asked: str) -> str | None:
        for k in range(attempts):
            try:
                return ask(asked)
            except Exception:  # whatever the injected client raises is that request's failure
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                if ask is None:
                    try:
                        ask = client(model)
                    except Exception:  # no caller: all requests of the batch fail
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string())], ["digest", "output"])
                        continue
                out = list(pool.map(lambda asked: answer(ask, asked), b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["digest", "output"])

    asked = requests.where("status = 200").select(key, prompt(F.coalesce("text", F.lit(""))).alias("asked")).withColumn("digest", F.unhex(F.sha2("asked", 256)))
    answers = asked.groupBy("digest").agg(F.first("asked").alias("asked")).mapInArrow(run, "digest binary, output string")
    called = asked.select(key, "digest").join(answers, "digest")
    return called.select(key, "output", *(c.alias(k) for k, c in _gate((F.col("output").isNull(), 500, "server_error")).items()))


def response_text(response: Column) -> Column:
    """The text of a model response given as JSON: output_text, else the first content of the first output, else ''."""
    first = F.nullif(F.get_json_object(response, "$.output_text"), F.lit(""))
    return F.coalesce(first, F.get_json_object(response, "$.output[0].content[0].text"), F.lit(""))


def _strict_json(text: Column) -> Column:
    """JSON text of a string that is one JSON value; null else.

    The parser stops behind the first value, so what follows it shows only inside
    brackets of both kinds.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull()
    return F.when(member.isNotNull() & single, F.to_json(F.try_parse_json(text)))


def parsed_reply(output: Column) -> dict[str, Column]:
    """parsed (JSON text) and raw: a reply's JSON, whole or from its first { to its last }.

    What isn't JSON, or is null, false, 0 or "", is returned as raw.
    """
    inner = F.nullif(F.regexp_extract(output, r"(?s)\{.*\}", 0), F.lit(""))
    text = F.coalesce(_strict_json(output), _strict_json(inner))
    falsy = text.isin("null", "false", "0", "0.0", "-0", '""')
    parsed = F.when(text.isNotNull() & ~falsy, text)
    return {"parsed": parsed, "raw": F.when(parsed.isNull(), output)}


def _error_body() -> Column:
    return F.to_json(F.struct(F.lit(False).alias("ok"), F.col("error")))


def analyze_reply(rows: DataFrame) -> DataFrame:
    """rows (status, error, parsed, raw) with the body that is sent: a result, else the raw reply, else the error."""
    said = F.when(F.col("parsed").isNotNull(), F.concat(F.lit('{"ok":true,"result":'), F.col("parsed"), F.lit("}")))
    said = said.otherwise(F.to_json(F.struct(F.lit(True).alias("ok"), F.coalesce("raw", F.lit("")).alias("raw"))))
    return rows.withColumn("body", F.when(F.col("status") == 200, said).otherwise(_error_body()))


def admin_reply(rows: DataFrame) -> DataFrame:
    """rows of gate_admin() with the body that is sent; a limited request gets plain text."""
    done = F.to_json(F.struct(F.lit(True).alias("ok"), F.col("set_enabled").alias("enabled")))
    return rows.withColumn("body", F.when(F.col("status") == 200, done).when(F.col("status") == 429, rules.SAID_TOO_MANY_REQUESTS).otherwise(_error_body()))


def status_reply(flag: DataFrame) -> DataFrame:
    """(body) of a request for the flag (enabled; null: false)."""
    return flag.select(F.to_json(F.struct(F.coalesce("enabled", F.lit(False)).alias("enabled"))).alias("body"))
