"""Scans of pages as a stream: unchanged pages are analysed once, and results meet what asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unchanged_once(pages: DataFrame, within: str = "1 day") -> DataFrame:
    """pages (url, html, ts, ...) without those that a page of the same address and content came before, in batch or on a stream.

    Put before an analysis, so that scanning an unchanged page again costs none. A stream
    remembers address and digest of a page, not its content, until the watermark, which is
    `within` behind the newest scan, has passed it; in batch nothing is forgotten. Null
    addresses and contents are equal to each other.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    known = pages.withColumn("__digest", F.concat_ws(" ", F.col("html").isNull().cast("string"), digest))
    if pages.isStreaming:
        once = known.withWatermark("ts", within).dropDuplicatesWithinWatermark(["url", "__digest"])
    else:
        once = known.dropDuplicates(["url", "__digest"])
    return once.drop("__digest")


def answered(asked: DataFrame, results: DataFrame, most: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """(tab_id, asked_seq, result_seq, delay_us): the results (tab_id, ts, seq) that follow what asks for them (tab_id, ts, seq) within `most`.

    On streams both sides may come `late`; a row waits for its partners until the watermarks
    of both have passed all that it can meet, and is then forgotten. In batch it is the same join.
    """
    a = asked.select(F.col("tab_id"), F.col("ts").cast("timestamp").alias("asked_ts"), F.col("seq").alias("asked_seq"))
    r = results.select(F.col("tab_id").alias("of_tab"), F.col("ts").cast("timestamp").alias("result_ts"), F.col("seq").alias("result_seq"))
    if asked.isStreaming:
        a, r = a.withWatermark("asked_ts", late), r.withWatermark("result_ts", late)
    near = F.expr(f"tab_id = of_tab and result_ts >= asked_ts and result_ts <= asked_ts + interval {most}")
    return a.join(r, near).select("tab_id", "asked_seq", "result_seq", (F.unix_micros("result_ts") - F.unix_micros("asked_ts")).alias("delay_us"))
