"""Scored findings: rules matched against overlapping chunks, rolled up for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.hits import MASKS, PARTS_TYPE, count_of, has_any, hits_of, struct_sql, with_hits, with_units
from ..functions.patterns import computed_sql, let, let_sql, text_sql, with_computed
from ..functions.text import chunks, distinct_evidence, sentences, shorten

FINDING = "array<struct<category:string,title:string,summary:string,confidence:string,severity:string,score:int,evidence:array<string>,count_as_risk:boolean,source_key:string>>"


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, i, sentence) of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "sentence"))


def unit_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, unit): the distinct chunks of docs (doc_id, text) in order."""
    split = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.posexplode(chunks("s")).alias("ord", "unit"))


#: No finding rule tells anything of a unit that matches none of these.
RULE_PATTERNS = tuple(dict.fromkeys([*(p for r in rules.FINDINGS for p in (*r.strong, *r.medium)), *rules.AD_TECH]))
CONTEXTS = {"negation": rules.NEGATION, "permission_limited": rules.PERMISSION, "safe_context": rules.SAFE_FUNCTION, "ad_tech": rules.AD_TECH}
CONTEXT_PATTERNS = tuple(dict.fromkeys(p for patterns in CONTEXTS.values() for p in patterns))


def _units(docs: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    rows = with_hits(docs.select("doc_id", sentences(F.col("text")).alias("s")), "s")
    rows = with_units(rows, "hits", lambda h: has_any(h, patterns))
    bits = F.struct(*(F.col(m) for m in MASKS)).alias("hits")
    return rows.select("doc_id", F.inline("units")).select("doc_id", "ord", "unit", "parts", bits)


def rule_units(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, unit, parts, hits): the rows of unit_rows() that a rule matches, with the bits of all patterns."""
    return _units(docs, RULE_PATTERNS)


def context_units(docs: DataFrame) -> DataFrame:
    """As rule_units(), for units that are in any context."""
    return _units(docs, CONTEXT_PATTERNS)


def with_context(units: DataFrame) -> DataFrame:
    """units (doc_id, ord, hits, ...) that are in any context, with the context flags."""
    flagged = units.withColumns({k: F.expr(has_any("hits.", patterns)) for k, patterns in CONTEXTS.items()})
    return flagged.where(" or ".join(CONTEXTS))


def matched(hits: str) -> str:
    """(rule_ord, strong_hits, medium_hits, ad_tech_hits, negated, permission_limited, safe_context, score) of each rule with a score above 0.

    All of it is SQL; hits are a unit's bits, the name of a struct and a dot.
    """
    tracking, sharing = (next(k for k, r in enumerate(rules.FINDINGS) if r.category == c) for c in ("tracking", "sharing"))
    details = [
        struct_sql({"rule_ord": str(k), "strong_hits": count_of(hits, r.strong), "medium_hits": count_of(hits, r.medium), "own_negation": has_any(hits, r.negations)})
        for k, r in enumerate(rules.FINDINGS)
    ]
    score = f"""4 * d.strong_hits + 2 * d.medium_hits + if(t.ad_tech, 3, 0)
      - case when d.own_negation then 5 when t.negation and d.strong_hits = 0 then 2 else 0 end - if(t.permission_limited, 2, 0)
      - case when t.safe_context and d.rule_ord = {tracking} then 3 when t.safe_context and d.rule_ord = {sharing} then 1 else 0 end"""
    fields = {c: f"d.{c}" for c in ("rule_ord", "strong_hits", "medium_hits")} | {"ad_tech_hits": "int(t.ad_tech)", "negated": "d.own_negation or (t.negation and n <= 2)"}
    fields |= {c: f"t.{c}" for c in ("permission_limited", "safe_context")} | {"score": "n"}
    some = f"filter(array({', '.join(details)}), d -> d.strong_hits > 0 or d.medium_hits > 0 or t.ad_tech)"
    scored = f"filter(transform({some}, d -> {let_sql(score, 'n', struct_sql(fields))}), x -> x.score > 0)"
    return let_sql(struct_sql({k: has_any(hits, patterns) for k, patterns in CONTEXTS.items()}), "t", scored)


def matches(units: DataFrame) -> DataFrame:
    """matched() for each row of units (doc_id, ord, unit, parts, hits), a row for each rule. Units without bits are tested one by one."""
    if "hits" not in units.columns:
        units = computed_sql(units, {"parts": f"cast(array() as {PARTS_TYPE})", "hits": hits_of("unit")})
    return units.select("doc_id", "ord", "unit", "parts", F.inline(F.expr(matched("hits."))))


def _totals() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in ("strong_hits", "medium_hits", "ad_tech_hits")]
    return sums + [F.bool_or(c).alias(c) for c in ("negated", "permission_limited", "safe_context")]


def hit_totals(matched: DataFrame) -> DataFrame:
    """Sums and flags for each document and rule."""
    return matched.groupBy("doc_id", "rule_ord").agg(*_totals())


def _strongest(unit: str, parts: str, rule: str) -> str:
    """The strongest part of a unit under a rule (its number), on ties the shorter, then the first; of one part nothing is compared. All of it is SQL."""
    own = " ".join(f"when {k} then 5 * {count_of('p.', r.strong)} + 2 * {count_of('p.', r.medium)}" for k, r in enumerate(rules.FINDINGS))
    strength = f"case {rule} {own} else 0 end + if({has_any('p.', rules.AD_TECH)}, 3, 0)"
    ranked = f"transform({parts}, (p, pos) -> named_struct('s', -({strength}), 'n', length(p.text), 'pos', pos, 'part', p.text))"
    return f"if(size({parts}) > 1, array_min({ranked}).part, {unit})"


def with_snippets(matched: DataFrame) -> DataFrame:
    """matched with its snippet and the unit's length in place of the unit, so that little is shuffled afterwards."""
    snippet = shorten(F.expr(_strongest("unit", "parts", "rule_ord")))
    return with_computed(matched, {"snippet": snippet, "length": F.length("unit")}).drop("unit", "parts")


def snippets(matched: DataFrame) -> DataFrame:
    """(doc_id, rule_ord, rank, ord, snippet) of each match, ranked by score, length and order."""
    place = W.partitionBy("doc_id", "rule_ord").orderBy(F.desc("score"), "length", "ord")
    return with_snippets(matched).select("doc_id", "rule_ord", F.row_number().over(place).alias("rank"), "ord", "snippet")


def _by_rule(rule: Column, value) -> Column:
    """A value (a text or number) of the rule of that number."""
    values = ", ".join(text_sql(v) if isinstance(v, str) else str(v) for v in map(value, rules.FINDINGS))
    return F.get(F.expr(f"array({values})"), rule)


def confidence(strong: Column, medium: Column, negated: Column, ad_tech: Column) -> Column:
    weak = negated & (strong == 0) & (medium <= 1) & (ad_tech == 0)
    explicit, likely = (strong >= 2) | (ad_tech >= 2), (strong >= 1) | (medium >= 3) | (ad_tech >= 1)
    return F.when(weak, "low").when(explicit, "explicit").when(likely, "likely").when(medium >= 1, "possible").otherwise("low")


def severity(x: Column) -> Column:
    """The rule's severity, lower where the top evidence puts it in context."""

    def of(top: Column) -> Column:
        lowered = F
        for k, rule in enumerate(rules.FINDINGS):
            if rule.category in rules.SEVERITY_CONTEXT:
                less = F.when(x["confidence"] == "explicit", "medium").otherwise("low") if rule.category == "tracking" else F.lit("low")
                lowered = lowered.when((x["rule_ord"] == k) & top.rlike(rules.SEVERITY_CONTEXT[rule.category]), less)
        return lowered.otherwise(_by_rule(x["rule_ord"], lambda r: r.severity))

    return let(F.lower(F.get(x["evidence"], F.lit(0))), of)


def summary(x: Column) -> Column:
    category = x["category"]
    negated = F
    for name, words in rules.SUMMARY_NEGATED.items():
        negated = negated.when(category == name, words)
    return (
        F.when((category == "tracking") & x["safe_context"], rules.SUMMARY_SAFE)
        .when(x["permission_limited"], F.when(category == "location", rules.SUMMARY_PERMISSION_LOCATION).otherwise(rules.SUMMARY_PERMISSION))
        .when(x["negated"], negated.otherwise(rules.SUMMARY_NEGATED_OTHER))
        .otherwise(_by_rule(x["rule_ord"], lambda r: r.summary))
    )


def finding_score(x: Column) -> Column:
    points = _by_rule(x["rule_ord"], lambda r: r.base_score)
    points += F.when(x["confidence"] == "explicit", 8).when(x["confidence"] == "likely", 4).when(x["confidence"] == "low", -6).otherwise(0)
    points += F.when(x["severity"] == "high", 4).when(x["severity"] == "low", -4).otherwise(0)
    points -= F.when(x["negated"] & (x["confidence"] != "explicit"), 6).otherwise(0)
    points -= F.when(x["permission_limited"], 3).otherwise(0)
    points -= F.when(x["safe_context"] & (x["category"] == "tracking"), 4).otherwise(0)
    return F.greatest(F.lit(4), points)


def counts_as_risk(category: Column, confidence: Column, severity: Column) -> Column:
    """High or medium severity, likely or explicit, and of a category that counts."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return low(severity).isin("high", "medium") & low(confidence).isin("likely", "explicit") & ~low(category).isin(*rules.UNCOUNTED)


def _rule_totals(matches: str) -> Column:
    """Sums, flags and evidence for each rule with a match, in rule order."""

    def total(k: Column) -> Column:
        def of(own: Column) -> Column:
            add, any_of = (lambda c: F.aggregate(own, F.lit(0), lambda s, x: s + x[c])), (lambda c: F.exists(own, lambda x: x[c]))
            sums = [add(c).alias(c) for c in ("strong_hits", "medium_hits", "ad_tech_hits")]
            flags = [any_of(c).alias(c) for c in ("negated", "permission_limited", "safe_context")]
            ranked = F.array_sort(F.transform(own, lambda x: F.struct((-x["score"]).alias("s"), x["length"].alias("length"), x["ord"].alias("ord"), x["snippet"].alias("snippet"))))
            evidence = distinct_evidence(F.transform(ranked, lambda x: x["snippet"]))
            return F.when(F.size(own) > 0, F.struct(k.alias("rule_ord"), *sums, *flags, evidence.alias("evidence")))

        return let(F.filter(matches, lambda x: x["rule_ord"] == k), of)

    return F.array_compact(F.transform(F.array(*(F.lit(k) for k in range(len(rules.FINDINGS)))), total))


def _finding(total: Column) -> Column:
    """A finding, behind what it is ranked by: score, ties by rule order."""

    def step(name: str, value) -> None:
        steps.append(lambda x: x.withField(name, value(x)))

    steps: list = []
    step("confidence", lambda x: confidence(*(x[c] for c in ("strong_hits", "medium_hits", "negated", "ad_tech_hits"))))
    step("category", lambda x: _by_rule(x["rule_ord"], lambda r: r.category))
    step("severity", severity)
    step("score", finding_score)

    def made(x: Column) -> Column:
        names = ("category", "confidence", "severity", "evidence")
        title, counted = _by_rule(x["rule_ord"], lambda r: r.title), counts_as_risk(x["category"], x["confidence"], x["severity"])
        return F.struct((-x["score"]).alias("s"), x["rule_ord"].alias("rule_ord"), x["score"].alias("score"), *(x[c].alias(c) for c in names), title.alias("title"), summary(x).alias("summary"), counted.alias("count_as_risk"))

    def run(x: Column, left: list) -> Column:
        return let(left[0](x), lambda y: run(y, left[1:])) if left else made(x)

    return run(total, steps)


def with_findings(docs: DataFrame, hits: str) -> DataFrame:
    """docs with findings, the best of each category, by score, from an array column of the hits of its sentences.

    All that findings need is in the row, so nothing is shuffled.
    """
    rows = with_units(docs, hits, lambda h: has_any(h, RULE_PATTERNS))
    told = ", ".join(f"'{c}', x.{c}" for c in ("rule_ord", "strong_hits", "medium_hits", "ad_tech_hits", "negated", "permission_limited", "safe_context", "score"))
    told = f"transform({matched('u.')}, x -> named_struct({told}, 'ord', u.ord, 'length', length(u.unit), 'snippet', {_strongest('u.unit', 'u.parts', 'x.rule_ord')}))"
    rows = computed_sql(rows, {"__matches": f"flatten(transform(units, u -> {told}))"}).drop("units")
    rows = with_computed(rows, {"__matches": F.transform("__matches", lambda x: x.withField("snippet", shorten(x["snippet"])))})
    rows = with_computed(rows, {"__totals": _rule_totals("__matches")}).drop("__matches")
    rows = with_computed(rows, {"__ranked": F.array_sort(F.transform("__totals", _finding))}).drop("__totals")
    best = F.filter("__ranked", lambda x, i: ~F.exists(F.slice("__ranked", 1, i), lambda y: y["category"] == x["category"]))
    names = ("category", "title", "summary", "confidence", "severity", "score", "evidence", "count_as_risk")
    made = F.transform(best, lambda x: F.struct(*(x[c].alias(c) for c in names), F.lit(None).cast("string").alias("source_key")))
    return rows.withColumn("findings", made.cast(FINDING)).drop("__ranked")


def findings_of(docs: DataFrame) -> DataFrame:
    """(doc_id, findings) of docs (doc_id, text)."""
    rows = with_hits(docs.select("doc_id", sentences(F.col("text")).alias("s")), "s")
    return with_findings(rows, "hits").drop("s", "hits")


def finding_rows(docs: DataFrame) -> DataFrame:
    """A row for each finding of docs (doc_id, text), with place, its rank."""
    rows = findings_of(docs).select("doc_id", F.posexplode("findings").alias("place", "f"))
    return rows.select("doc_id", (F.col("place") + 1).alias("place"), "f.*")
