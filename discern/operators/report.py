"""Presentation of results, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

DOT = " • "


def _label(value: Column, table: dict[str, str]) -> Column:
    low, out = F.lower(F.trim(F.coalesce(value, F.lit("")))), F
    for key, text in table.items():
        out = out.when(low == key, text)
    return out.otherwise(F.coalesce(value, F.lit("")))


def confidence_label(value: Column) -> Column:
    return _label(value, rules.CONFIDENCE_LABEL)


def severity_label(value: Column) -> Column:
    return _label(value, rules.SEVERITY_LABEL)


def counted(findings: str | Column) -> Column:
    return F.filter(F.coalesce(findings, F.array().cast("array<struct<count_as_risk:boolean>>")) if isinstance(findings, Column) else findings, lambda f: F.coalesce(f["count_as_risk"], F.lit(False)))


def findings_report(results: DataFrame, key: str, limit: int = 6) -> DataFrame:
    """(key, pos, title, meta, summary, evidence_label, evidence): a card for each counted finding of a policy page.

    A result without one has a single row, pos -1, whose title says why.
    """
    policy = F.coalesce("is_likely_policy_page", F.lit(False))
    shown = F.when(policy, F.slice(counted("findings"), 1, limit))
    rows = results.select(key, "is_likely_policy_page", F.posexplode_outer(F.when(F.size(shown) > 0, shown)).alias("pos", "f"))
    empty = (
        F.when(F.col("is_likely_policy_page").isNull(), rules.SAID_NO_MEANINGFUL_PRIVACY_RISKS_ARE)
        .when(~F.col("is_likely_policy_page"), rules.SAID_OPEN_THE_LIKELY_POLICY_PAGE)
        .otherwise(rules.SAID_NO_MEANINGFUL_PRIVACY_RISKS_WERE)
    )
    meta = F.array_join(F.filter(F.array(confidence_label(F.col("f.confidence")), severity_label(F.col("f.severity"))), lambda x: x != ""), DOT)
    n = F.least(F.lit(2), F.coalesce(F.size("f.evidence"), F.lit(0)))
    return rows.select(
        key,
        F.coalesce("pos", F.lit(-1)).alias("pos"),
        F.when(F.col("f").isNull(), empty).otherwise(F.coalesce(F.nullif("f.title", F.lit("")), F.lit(rules.SAID_POSSIBLE_PRIVACY_CONCERN))).alias("title"),
        F.when(F.col("f").isNull(), "").otherwise(meta).alias("meta"),
        F.coalesce("f.summary", F.lit("")).alias("summary"),
        F.when(n > 0, F.concat(F.lit(rules.SAID_SHOW_EVIDENCE), n.cast("string"), F.lit(")"))).otherwise("").alias("evidence_label"),
        F.coalesce(F.array_join(F.slice("f.evidence", 1, 2), "\n"), F.lit("")).alias("evidence"),
    )


def reasons_report(results: DataFrame, key: str, limit: int = rules.MAX_REASONS) -> DataFrame:
    """(key, pos, reason): the counted findings of a policy page, or one row, pos -1, that says why there is none."""
    policy = F.coalesce("is_likely_policy_page", F.lit(False))
    shown = F.when(policy, F.slice(counted("findings"), 1, limit))
    rows = results.select(key, "is_likely_policy_page", F.posexplode_outer(F.when(F.size(shown) > 0, shown)).alias("pos", "f"))
    empty = (
        F.when(F.col("is_likely_policy_page").isNull(), rules.SAID_NO_MEANINGFUL_RISKS_ARE_AVAILABLE)
        .when(~F.col("is_likely_policy_page"), rules.SAID_MEANINGFUL_PRIVACY_RISKS_ARE_ONLY)
        .otherwise(rules.SAID_NO_MEANINGFUL_PRIVACY_RISKS_WERE)
    )
    said = F.coalesce(F.nullif("f.title", F.lit("")), F.nullif("f.summary", F.lit("")), F.lit(rules.SAID_POSSIBLE_PRIVACY_CONCERN_DETECTED))
    return rows.select(key, F.coalesce("pos", F.lit(-1)).alias("pos"), F.when(F.col("f").isNull(), empty).otherwise(said).alias("reason"))


def checklist(results: DataFrame, key: str) -> DataFrame:
    """(key, pos, category, label, checked, message, quote): the categories of each result, in fixed order.

    Results without any category have a single note, pos -1; results that aren't policy
    pages have a note in front.
    """
    policy = F.coalesce("is_likely_policy_page", F.lit(False))
    prefix = F.when(policy, rules.PREFIX_POLICY).otherwise(rules.PREFIX_OTHER)
    collected = F.coalesce("data_collected", F.create_map().cast("map<string,boolean>"))
    found = F.exists(F.map_values(collected), lambda x: F.coalesce(x, F.lit(False)))

    def row(pos: int, category: str, label: Column, checked: Column, message: Column, quote: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), F.lit(category).alias("category"), label.alias("label"), checked.alias("checked"), message.alias("message"), quote.alias("quote"))

    def note(text: Column) -> Column:
        return row(-1, "note", text, F.lit(False), F.lit(""), F.lit(""))

    rows = []
    for pos, (k, (label, message)) in enumerate(rules.CHECKLIST.items()):
        checked = F.coalesce(F.try_element_at(collected, F.lit(k)), F.lit(False))
        shown = F.slice(F.coalesce(F.try_element_at("data_evidence", F.lit(k)), F.array().cast("array<string>")), 1, 2)
        quote = F.when(checked & (F.size(shown) > 0), F.concat(F.lit(rules.SAID_EVIDENCE), F.array_join(shown, DOT))).otherwise("")
        rows.append(row(pos, k, F.lit(label), checked, F.when(checked, F.concat(prefix, F.lit(message))).otherwise(""), quote))
    nothing = F.when(policy, rules.SAID_PRIVACY_POLICY_DETECTED_BUT_NO).otherwise(rules.SAID_NO_CLEAR_PRIVACY_RELATED_DATA)
    estimate = F.when(policy, F.array().cast("array<struct<pos:int,category:string,label:string,checked:boolean,message:string,quote:string>>")).otherwise(
        F.array(note(F.lit(rules.SAID_ESTIMATED_FROM_CURRENT_PAGE_CONTENT)))
    )
    lines = F.when(found, F.concat(estimate, F.array(*rows))).otherwise(F.array(note(nothing)))
    return results.select(key, F.inline(lines))


def page_status(results: DataFrame) -> DataFrame:
    """results with status, status_class, finder_status, headline, link_text and link_enabled."""
    none, policy = F.col("is_likely_policy_page").isNull(), F.coalesce("is_likely_policy_page", F.lit(False))
    link = F.coalesce("best_policy_link", F.lit(""))
    n, high, medium = F.col("risks"), F.col("high_risks"), F.col("medium_risks")
    word = F.when(n == 1, " risk").otherwise(" risks")
    detected = F.concat(n.cast("string"), word, F.lit(" detected"))
    status = (
        F.when(none, rules.SAID_REFRESH_THE_PAGE_TO_CHECK)
        .when(~policy, F.when(link != "", rules.SAID_LIKELY_POLICY_LINK_FOUND).otherwise(rules.SAID_NO_LIKELY_POLICY_LINK_WAS))
        .when(high > 0, F.concat(detected, F.lit(" ("), high.cast("string"), F.lit(" high-impact)")))
        .when(medium > 0, detected)
        .otherwise(rules.SAID_NO_MAJOR_PRIVACY_RISKS_DETECTED)
    )
    finder = (
        F.when(none, rules.SAID_NO_PAGE_CHECKED_YET)
        .when(policy, "")
        .when(link != "", rules.SAID_PRIVACY_POLICY_NOT_DETECTED_ON)
        .otherwise(rules.SAID_PRIVACY_POLICY_NOT_DETECTED_ON_2)
    )
    headline = (
        F.when(none, rules.SAID_NO_HEURISTIC_RESULT_YET)
        .when(~policy & (link != ""), rules.SAID_OPEN_THE_LIKELY_POLICY_PAGE_2)
        .when(~policy, rules.SAID_THIS_PAGE_CAN_STILL_SHOW)
        .when(n > 0, F.concat(F.lit(rules.SAID_THIS_POLICY_SHOWS), n.cast("string"), F.lit(" meaningful privacy"), word, F.lit(". Review the findings below for the biggest concerns.")))
        .when(F.size("findings") > 0, rules.SAID_THIS_POLICY_WAS_DETECTED_BUT)
        .otherwise(rules.SAID_THIS_APPEARS_TO_BE_THE)
    )
    color = F.when(~policy, "status-blue").when(high > 0, "status-red").when(medium > 0, "status-yellow").otherwise("status-green")
    return results.withColumns(
        {"status": status, "status_class": color, "finder_status": finder, "headline": headline, "link_text": F.when(link != "", link).otherwise(rules.SAID_NO_POLICY_LINK_FOUND), "link_enabled": link != ""}
    )
