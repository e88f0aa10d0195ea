"""From pages or documents to results, risks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.hits import with_hits
from ..functions.patterns import with_computed
from ..functions.text import sentences
from ..operators import categories, detect, findings, risk
from ..operators.report import counted
from ..sources.pages import parsed_pages


def analyze_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """A result for each row of docs (doc_id, text, title, url; best_policy_link, best_link_score if there are any), and its columns `keep`.

    Findings are made for likely policy pages only, data categories for all. Null text,
    title or url count as empty. Each row is worked on by itself: one scan, no exchange.
    """
    texts = docs.withColumn("page_text", F.left(F.coalesce("text", F.lit("")), F.lit(rules.MAX_TEXT))).drop("text")
    for name, none in (("best_policy_link", F.lit("")), ("best_link_score", F.lit(0))):
        if name not in docs.columns:
            texts = texts.withColumn(name, none)
    scored = detect.scored_pages(texts)
    rows = with_computed(scored, {"__sentences": sentences(F.col("page_text"))}).drop("page_text")
    rows = with_hits(rows, "__sentences", "__hits").drop("__sentences")
    rows = rows.withColumn("__policy", F.when(F.col("is_likely_policy_page"), F.col("__hits")).otherwise(F.slice("__hits", 1, 0)))
    rows = findings.with_findings(rows, "__policy").drop("__policy")
    rows = categories.with_categories(rows, "__hits").drop("__hits")
    risks = counted("findings")
    return rows.select(
        "doc_id",
        *keep,
        "is_likely_policy_page",
        "page_score",
        "score",
        "confidence",
        "best_policy_link",
        "best_link_score",
        F.transform(F.slice(risks, 1, rules.MAX_REASONS), lambda f: f["title"]).alias("reasons"),
        "findings",
        F.size(risks).alias("counted_risk_count"),
        "data_collected",
        "data_evidence",
        F.col("title").alias("page_title"),
        F.col("url").alias("page_url"),
    )


def analyze_pages(pages: DataFrame, bare: bool = True) -> DataFrame:
    """A result for each row of pages (page_id, url, html); bare as in parse_page()."""
    rows = detect.with_best_link(parsed_pages(pages, "title", "page_text", "links", bare=bare))
    return analyze_texts(rows.withColumnsRenamed({"page_id": "doc_id", "page_text": "text"}))


def assess(results: DataFrame) -> DataFrame:
    """Results made whole, with risk columns."""
    return risk.risks(risk.normalized(results))
