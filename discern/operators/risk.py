"""Normalised results, risk scores and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .findings import FINDING, counts_as_risk


def _lookup(value: Column, table: dict, default) -> Column:
    low, out = F.lower(F.trim(F.coalesce(value, F.lit("")))), F
    for key, x in table.items():
        out = out.when(low == key, x)
    return out.otherwise(default)


def confidence_weight(value: Column) -> Column:
    return _lookup(value, rules.CONFIDENCE_WEIGHT, 0.75)


def severity_weight(value: Column) -> Column:
    return _lookup(value, rules.SEVERITY_WEIGHT, 1.0)


def category_weight(value: Column) -> Column:
    return _lookup(value, rules.CATEGORY_WEIGHT, 10)


def legacy_findings(collected: Column, evidence: Column) -> Column:
    """Findings made from the data categories of a result (two maps, either null), in category order.

    Keys outside the known ones follow in map order, with default wording.
    """
    collected = F.coalesce(collected, F.create_map().cast("map<string,boolean>"))
    evidence = F.coalesce(evidence, F.create_map().cast("map<string,array<string>>"))
    none = F.array().cast("array<string>")

    def finding(key: Column, category: str, title: str, text: str, confidence: str, severity: str, score: int) -> Column:
        counted = counts_as_risk(F.lit(category), F.lit(confidence), F.lit(severity))
        shown = F.slice(F.coalesce(F.try_element_at(evidence, key), none), 1, rules.MAX_EVIDENCE)
        parts = [F.lit(x) for x in (category, title, text, confidence, severity)]
        names = ("category", "title", "summary", "confidence", "severity")
        return F.struct(*(p.alias(n) for p, n in zip(parts, names)), F.lit(score).alias("score"), shown.alias("evidence"), counted.alias("count_as_risk"), key.alias("source_key"))

    known = F.array(*(F.when(F.coalesce(F.try_element_at(collected, F.lit(k)), F.lit(False)), finding(F.lit(k), *rest)) for k, *rest in rules.LEGACY))
    others = F.filter(F.map_keys(F.map_filter(collected, lambda _, v: v)), lambda k: ~k.isin(*(k for k, *_ in rules.LEGACY)))
    return F.concat(F.array_compact(known).cast(FINDING), F.transform(others, lambda k: finding(k, *rules.LEGACY_DEFAULT)).cast(FINDING))


def normalized(results: DataFrame) -> DataFrame:
    """results with findings and counted_risk_count made whole.

    Findings keep a boolean count_as_risk, else it is worked out; without findings they
    come from the data categories. A given counted_risk_count stays, even where it
    disagrees with the findings.
    """
    given = F.transform("findings", lambda f: f.withField("count_as_risk", F.coalesce(f["count_as_risk"], counts_as_risk(f["category"], f["confidence"], f["severity"]))))
    findings = F.when(F.coalesce(F.size("findings"), F.lit(0)) > 0, given).otherwise(legacy_findings(F.col("data_collected"), F.col("data_evidence")))
    rows = results.withColumn("findings", findings)
    return rows.withColumn("counted_risk_count", F.coalesce("counted_risk_count", F.size(F.filter("findings", lambda f: f["count_as_risk"]))))


def raw_risk(findings: Column) -> Column:
    """Sum over counted findings of score times weights, and 2 with evidence; in their order."""

    def item(f: Column) -> Column:
        base = F.coalesce(f["score"], category_weight(f["category"])).cast("double")
        return base * confidence_weight(f["confidence"]) * severity_weight(f["severity"]) + F.when(F.size(f["evidence"]) > 0, 2.0).otherwise(0.0)

    return F.aggregate(F.filter(findings, lambda f: f["count_as_risk"]), F.lit(0.0), lambda s, f: s + item(f))


def risk_counts(findings: Column) -> dict[str, Column]:
    of = lambda level: F.size(F.filter(findings, lambda f: f["count_as_risk"] & (F.lower(f["severity"]) == level)))
    return {"risks": F.size(F.filter(findings, lambda f: f["count_as_risk"])), "high_risks": of("high"), "medium_risks": of("medium")}


def level(score: Column) -> Column:
    return F.when(score >= 70, "red").when(score >= 35, "yellow").otherwise("blue")


def risks(results: DataFrame) -> DataFrame:
    """results with risk_score, issues_count, level_hint, risk_summary, level and the toolbar columns.

    A row with null is_likely_policy_page has no analysis yet.
    """
    rows = results.withColumns(risk_counts(F.col("findings")))
    none, policy = F.col("is_likely_policy_page").isNull(), F.coalesce("is_likely_policy_page", F.lit(False))
    linked = (F.coalesce("best_policy_link", F.lit("")) != "") & (F.coalesce("best_link_score", F.lit(0)) >= rules.STRONG_LINK)
    page = F.lower(F.coalesce("confidence", F.lit("")))
    raw = raw_risk(F.col("findings")) + F.when(F.col("risks") > 0, F.when(page == "high", 4.0).when(page == "low", -4.0).otherwise(0.0)).otherwise(0.0)
    score = F.when(policy, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5)))).otherwise(0).cast("int")
    hint = F.when(none, "none").when(~policy, F.when(linked, "policy-link").otherwise("none")).when(F.col("high_risks") > 0, "high-risk").when(F.col("medium_risks") > 0, "policy-risk").otherwise("policy")
    said = (
        F.when(none, rules.SAID_NO_ANALYSIS_YET)
        .when(~policy, F.when(linked, rules.SAID_LIKELY_POLICY_LINK_FOUND_2).otherwise(rules.SAID_NO_POLICY_DETECTED))
        .when(F.col("high_risks") > 0, rules.SAID_HIGH_PRIVACY_CONCERN)
        .when(F.col("medium_risks") > 0, rules.SAID_POTENTIAL_PRIVACY_CONCERNS)
        .when(F.size("findings") > 0, rules.SAID_LOW_IMPACT_FINDINGS_ONLY)
        .otherwise(rules.SAID_PRIVACY_POLICY_DETECTED)
    )
    rows = rows.withColumns({"risk_score": score, "issues_count": F.when(policy, F.col("risks")).otherwise(0), "level_hint": hint, "risk_summary": said})
    return toolbar(rows)


def toolbar(rows: DataFrame) -> DataFrame:
    """level, badge_text, badge_color, icons and toolbar_title of risk rows."""
    issues = F.col("issues_count")
    flagged = F.concat(F.col("risk_summary"), F.lit(": "), issues.cast("string"), F.when(issues == 1, " risk flagged").otherwise(" risks flagged"))
    title = (
        F.when(F.col("level_hint") == "policy-link", rules.SAID_LIKELY_PRIVACY_POLICY_LINK_FOUND)
        .when(F.col("level_hint") == "policy", F.when(issues > 0, flagged).otherwise(rules.SAID_PRIVACY_POLICY_DETECTED_NO_MAJOR))
        .when(F.col("level_hint").isin("policy-risk", "high-risk"), F.concat(flagged, F.lit(" — click to review")))
        .otherwise(rules.SAID_NO_POLICY_DETECTED_YET)
    )
    rows = rows.withColumn("level", level(F.col("risk_score")))
    color = F.when(F.col("level") == "red", "#D93025").when(F.col("level") == "yellow", "#F9AB00").otherwise("#1A73E8")
    icons = F.create_map(*(x for size in (16, 32, 48, 128) for x in (F.lit(size), F.concat(F.lit("icons/"), F.col("level"), F.lit(f"{size}.png")))))
    return rows.withColumns({"badge_text": F.when(issues > 0, F.least(issues, F.lit(99)).cast("string")).otherwise(""), "badge_color": color, "icons": icons, "toolbar_title": title})
