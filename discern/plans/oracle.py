"""The registered queries in SQL for DuckDB, built from the same rule pack."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import rules
from ..operators.requests import MOST_TEXT
from ..sources.flags import DEFAULTS
from ..sources.pages import FLOW, SILENT
from ..streaming.tabs import RECHECK_MS
from . import corpus

BAR = " ¦ "


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q('(?i)' + pattern)})"


def count(column: str, patterns: Iterable[str]) -> str:
    return "(" + " + ".join([f"{has(column, p)}::INT" for p in patterns] or ["0"]) + ")"


def some(column: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join([has(column, p) for p in patterns] or ["false"]) + ")"


def case(pairs: Iterable[tuple[str, object]], other: object) -> str:
    lit = lambda x: q(x) if isinstance(x, str) else ("true" if x is True else "false" if x is False else str(x))
    whens = " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in pairs)
    return f"(CASE {whens} ELSE {lit(other)} END)"


def pick(key: str, values: Iterable[str]) -> str:
    values = list(values)
    return case([(f"{key} % {len(values)} = {k}", v) for k, v in enumerate(values)], "")


def norm(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0B]+', ' ', 'g'))"


# ---- shared tables ------------------------------------------------------------------

_PHRASES = [f"{s} {corpus.SEEDS[(k + corpus.SHIFT) % len(corpus.SEEDS)]}" for k, s in enumerate(corpus.SEEDS)]
DOCS = f"""docs AS (
  SELECT doc_id, text || chr(10) || {pick('doc_id', _PHRASES)} AS text, lang, source,
    {pick('doc_id', [t for t, _ in corpus.PAGES])} AS title, {pick('doc_id', [u for _, u in corpus.PAGES])} AS url, '' AS link, false AS linked
  FROM documents)"""


def sent(source: str, name: str = "sent", text: str = "text") -> str:
    return rf"""{name}_l AS (SELECT doc_id, string_split(regexp_replace({text}, '([.!?])[\s\x0B]+|\n+', '\1' || chr(1), 'g'), chr(1)) AS l FROM {source}),
{name}_r AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM {name}_l),
{name}_n AS (SELECT doc_id, j, {norm('s')} AS sentence FROM {name}_r),
{name} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1)::INT AS i, sentence FROM {name}_n
  WHERE length(sentence) >= {rules.LEAST_SENTENCE} QUALIFY i < {rules.MAX_SENTENCES})"""


SENT = DOCS + ",\n" + sent("docs")
UNITS_OF = """runs AS (SELECT doc_id, i, sentence AS a, lead(sentence, 1) OVER w AS b, lead(sentence, 2) OVER w AS c FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
each_run AS (SELECT doc_id, 3 * i AS seq, a AS unit FROM runs
  UNION ALL SELECT doc_id, 3 * i + 1, a || ' ' || b FROM runs WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, 3 * i + 2, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY min(seq)) - 1)::INT AS ord, unit FROM each_run GROUP BY doc_id, unit)"""
UNITS = SENT + ",\n" + UNITS_OF
CONTEXT_OF = f"""ctx AS (SELECT doc_id, ord, unit, {some('unit', rules.NEGATION)} AS negation, {some('unit', rules.PERMISSION)} AS permission_limited,
  {some('unit', rules.SAFE_FUNCTION)} AS safe_context, {some('unit', rules.AD_TECH)} AS ad_tech FROM units)"""
_EACH = "\nUNION ALL ".join(
    f"SELECT doc_id, {k} AS rule_ord, ord, unit, {count('unit', r.strong)} AS strong_hits, {count('unit', r.medium)} AS medium_hits, {some('unit', r.negations)} AS own, negation, permission_limited, safe_context, ad_tech::INT AS ad_tech_hits FROM ctx"
    for k, r in enumerate(rules.FINDINGS)
)
_RULE = {r.category: k for k, r in enumerate(rules.FINDINGS)}
MATCHES_OF = (
    CONTEXT_OF
    + f""",
every AS ({_EACH}),
scored AS (SELECT *, 4 * strong_hits + 2 * medium_hits + 3 * ad_tech_hits
  - CASE WHEN own THEN 5 WHEN negation AND strong_hits = 0 THEN 2 ELSE 0 END - CASE WHEN permission_limited THEN 2 ELSE 0 END
  - CASE WHEN safe_context AND rule_ord = {_RULE['tracking']} THEN 3 WHEN safe_context AND rule_ord = {_RULE['sharing']} THEN 1 ELSE 0 END AS score FROM every),
m AS (SELECT doc_id, rule_ord, ord, unit, strong_hits, medium_hits, ad_tech_hits, own OR (negation AND score <= 2) AS negated, permission_limited, safe_context, score::INT AS score FROM scored WHERE score > 0)"""
)
MATCHES = UNITS + ",\n" + MATCHES_OF
TOTALS = """tot AS (SELECT doc_id, rule_ord, sum(strong_hits)::BIGINT AS strong_hits, sum(medium_hits)::BIGINT AS medium_hits, sum(ad_tech_hits)::BIGINT AS ad_tech_hits,
  bool_or(negated) AS negated, bool_or(permission_limited) AS permission_limited, bool_or(safe_context) AS safe_context FROM m GROUP BY doc_id, rule_ord)"""


def last_index(text: str, part: str) -> str:
    back = q(part[::-1])
    return f"(CASE WHEN strpos(reverse({text}), {back}) = 0 THEN -1 ELSE length({text}) - strpos(reverse({text}), {back}) - {len(part)} + 1 END)"


def shorten(x: str, most: int = 220, least: int = 80) -> str:
    clean = norm(x)
    head = f"left({clean}, {most})"
    clause = "greatest(" + ", ".join(last_index(head, p) for p in (". ", "; ", ", ")) + ")"
    blank = last_index(head, " ")
    return f"(CASE WHEN length({clean}) <= {most} THEN {clean} WHEN {clause} > {least} THEN trim(left({head}, {clause} + 1)) WHEN {blank} > {least} THEN trim(left({head}, {blank})) || '…' ELSE trim({head}) || '…' END)"


def compare_key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[\s\x0B]+', ' ', 'g'), {q('[“”' + chr(34) + chr(39) + '`]')}, '', 'g'))"


_STRENGTH = "(CASE " + " ".join(f"WHEN rule_ord = {k} THEN 5 * {count('part', r.strong)} + 2 * {count('part', r.medium)}" for k, r in enumerate(rules.FINDINGS)) + f" ELSE 0 END + CASE WHEN {some('part', rules.AD_TECH)} THEN 3 ELSE 0 END)"
SNIPPETS_OF = rf"""cut_l AS (SELECT doc_id, rule_ord, ord, unit, score, string_split(regexp_replace(unit, '([.!?])[\s\x0B]+|\n+', '\1' || chr(1), 'g'), chr(1)) AS l FROM m),
cut_r AS (SELECT doc_id, rule_ord, ord, unit, score, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM cut_l),
cut AS (SELECT doc_id, rule_ord, ord, unit, score, pos, {norm('s')} AS part FROM cut_r),
strong AS (SELECT *, {_STRENGTH} AS strength FROM cut WHERE length(part) >= {rules.LEAST_SENTENCE}),
best AS (SELECT doc_id, rule_ord, ord, part FROM strong QUALIFY row_number() OVER (PARTITION BY doc_id, rule_ord, ord ORDER BY strength DESC, length(part), pos) = 1),
chosen AS (SELECT m.doc_id, m.rule_ord, (row_number() OVER (PARTITION BY m.doc_id, m.rule_ord ORDER BY m.score DESC, length(m.unit), m.ord))::INT AS rank, m.ord, coalesce(part, unit) AS x
  FROM m LEFT JOIN best USING (doc_id, rule_ord, ord)),
snip AS (SELECT doc_id, rule_ord, rank, ord, {shorten('x')} AS snippet FROM chosen)"""
#: Greedy choice in rank order: the walk keeps the keys taken so far, and skips to the next snippet that none of them holds.
EVIDENCE_OF = f"""keyed AS (SELECT doc_id, rule_ord, min(rank) AS rank, k, arg_min(snippet, rank) AS snippet FROM (SELECT *, {compare_key('snippet')} AS k FROM snip) WHERE k <> '' GROUP BY doc_id, rule_ord, k),
first_taken AS (SELECT doc_id, rule_ord, arg_min(k, rank) AS k1, arg_min(snippet, rank) AS s1, min(rank) AS r1 FROM keyed GROUP BY ALL),
second_taken AS (SELECT f.doc_id, f.rule_ord, arg_min(k, rank) AS k2, arg_min(snippet, rank) AS s2, min(rank) AS r2 FROM first_taken f JOIN keyed USING (doc_id, rule_ord)
  WHERE rank > r1 AND NOT contains(k, k1) AND NOT contains(k1, k) GROUP BY ALL),
third_taken AS (SELECT f.doc_id, f.rule_ord, arg_min(snippet, rank) AS s3 FROM first_taken f JOIN second_taken USING (doc_id, rule_ord) JOIN keyed USING (doc_id, rule_ord)
  WHERE rank > r2 AND NOT contains(k, k1) AND NOT contains(k1, k) AND NOT contains(k, k2) AND NOT contains(k2, k) GROUP BY ALL),
evid AS (SELECT doc_id, rule_ord, s1 AS top, s1 || coalesce('{BAR}' || s2, '') || coalesce('{BAR}' || s3, '') AS evidence, s1, s2 FROM first_taken LEFT JOIN second_taken USING (doc_id, rule_ord) LEFT JOIN third_taken USING (doc_id, rule_ord))"""

_by = lambda f: case([(f"rule_ord = {k}", f(r)) for k, r in enumerate(rules.FINDINGS)], 0 if isinstance(f(rules.FINDINGS[0]), int) else "")
_NEGATED = case([(f"category = '{c}'", s) for c, s in rules.SUMMARY_NEGATED.items()], rules.SUMMARY_NEGATED_OTHER)
FINDINGS_OF = f"""conf AS (SELECT *, {_by(lambda r: r.category)} AS category, {_by(lambda r: r.title)} AS title, {_by(lambda r: r.summary)} AS summary0, {_by(lambda r: r.severity)} AS severity0, {_by(lambda r: r.base_score)} AS base,
  CASE WHEN negated AND strong_hits = 0 AND medium_hits <= 1 AND ad_tech_hits = 0 THEN 'low' WHEN strong_hits >= 2 OR ad_tech_hits >= 2 THEN 'explicit'
    WHEN strong_hits >= 1 OR medium_hits >= 3 OR ad_tech_hits >= 1 THEN 'likely' WHEN medium_hits >= 1 THEN 'possible' ELSE 'low' END AS confidence FROM tot LEFT JOIN evid USING (doc_id, rule_ord)),
sev AS (SELECT *, CASE WHEN category = 'tracking' AND regexp_matches(lower(top), {q(rules.SEVERITY_CONTEXT['tracking'])}) THEN CASE WHEN confidence = 'explicit' THEN 'medium' ELSE 'low' END
    WHEN category = 'location' AND regexp_matches(lower(top), {q(rules.SEVERITY_CONTEXT['location'])}) THEN 'low'
    WHEN category = 'sharing' AND regexp_matches(lower(top), {q(rules.SEVERITY_CONTEXT['sharing'])}) THEN 'low' ELSE severity0 END AS severity FROM conf),
fin AS (SELECT *, greatest(4, base + CASE confidence WHEN 'explicit' THEN 8 WHEN 'likely' THEN 4 WHEN 'low' THEN -6 ELSE 0 END + CASE severity WHEN 'high' THEN 4 WHEN 'low' THEN -4 ELSE 0 END
    - CASE WHEN negated AND confidence <> 'explicit' THEN 6 ELSE 0 END - CASE WHEN permission_limited THEN 3 ELSE 0 END - CASE WHEN safe_context AND category = 'tracking' THEN 4 ELSE 0 END)::INT AS score,
  CASE WHEN category = 'tracking' AND safe_context THEN {q(rules.SUMMARY_SAFE)} WHEN permission_limited THEN CASE WHEN category = 'location' THEN {q(rules.SUMMARY_PERMISSION_LOCATION)} ELSE {q(rules.SUMMARY_PERMISSION)} END
    WHEN negated THEN {_NEGATED} ELSE summary0 END AS summary,
  severity IN ('high', 'medium') AND confidence IN ('likely', 'explicit') AND category NOT IN ('retention', 'children') AS count_as_risk FROM sev),
found AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule_ord))::INT AS place FROM fin)"""
FOUND = ",\n".join((MATCHES, SNIPPETS_OF, TOTALS, EVIDENCE_OF, FINDINGS_OF))


def page_score(text: str, title: str, url: str) -> str:
    head = f"({title} || ' ' || {url})"
    points = lambda x, pairs: case([(has(x, p), n) for p, n in pairs], 0)
    return f"(2 * {count(text, rules.STRONG_PAGE)} + 3 * {count(head, rules.STRONG_PAGE)} + {count(text, rules.WEAK_PAGE)} + {count(head, rules.WEAK_PAGE)} + {points(url, rules.URL_POINTS)} + {points(title, rules.TITLE_POINTS)} + {case([(has(text, rules.TEXT_BONUS[0]), rules.TEXT_BONUS[1])], 0)})"


_DISPLAY = "least(10, greatest(0, floor(page_score / 2 + 0.5)))::INT AS score, CASE WHEN page_score >= 14 THEN 'High' WHEN page_score >= 8 THEN 'Medium' ELSE 'Low' END AS confidence, page_score >= 8 AS is_likely_policy_page"
DOC_SCORE_OF = f"""pscore AS (SELECT doc_id, {page_score(f'left(text, {rules.MAX_TEXT})', 'title', 'url')}::INT AS page_score, title, url, link, linked FROM docs),
page AS (SELECT *, {_DISPLAY} FROM pscore)"""
CATS_OF = f"""cat(pos, category) AS (VALUES {', '.join(f'({i}, {q(k)})' for i, k in enumerate(rules.CATEGORIES))}),
shown AS ({' UNION ALL '.join(f"SELECT doc_id, {q(k)} AS category, i, sentence FROM sent WHERE {some('sentence', p)}" for k, p in rules.CATEGORIES.items())}),
firsts AS (SELECT doc_id, category, list(sentence ORDER BY i) AS e FROM (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY i) <= {rules.MAX_EVIDENCE}) GROUP BY ALL),
cats AS (SELECT doc_id, pos, category, e IS NOT NULL AS present, coalesce(e, []) AS e FROM docs CROSS JOIN cat LEFT JOIN firsts USING (doc_id, category))"""
LEGACY_OF = f"""leg(pos, source_key, category, title, summary, confidence, severity, score) AS (VALUES {', '.join('(' + ', '.join([str(i), *(q(x) if isinstance(x, str) else str(x) for x in row)]) + ')' for i, row in enumerate(rules.LEGACY))}),
lf AS (SELECT c.doc_id, leg.*, c.e, leg.severity IN ('high', 'medium') AND leg.confidence IN ('likely', 'explicit') AND leg.category NOT IN ('retention', 'children') AS count_as_risk
  FROM cats c JOIN leg ON c.category = leg.source_key WHERE c.present)"""
#: Findings of policy pages, else those of their data categories, in order.
WHOLE_OF = f"""own AS (SELECT found.*, s1 AS ev1, s2 AS ev2 FROM found JOIN page USING (doc_id) WHERE is_likely_policy_page),
whole AS (SELECT doc_id, place AS pos, category, title, summary, confidence, severity, score, s1 AS e1, s2 AS e2, count_as_risk FROM own
  UNION ALL SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT, category, title, summary, confidence, severity, score, e[1], e[2], count_as_risk FROM lf WHERE doc_id NOT IN (SELECT doc_id FROM own))"""
_WEIGHT = lambda x, table, other: "(CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other}::DOUBLE END)"
RISK_OF = f"""item AS (SELECT doc_id, pos, score::DOUBLE * {_WEIGHT('confidence', rules.CONFIDENCE_WEIGHT, 0.75)} * {_WEIGHT('severity', rules.SEVERITY_WEIGHT, 1.0)} + CASE WHEN e1 IS NOT NULL THEN 2 ELSE 0 END AS w, severity FROM whole WHERE count_as_risk),
sums AS (SELECT doc_id, list_sum(list(w ORDER BY pos)) AS raw, count(*)::INT AS risks, count_if(severity = 'high')::INT AS high_risks, count_if(severity = 'medium')::INT AS medium_risks FROM item GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_findings FROM whole GROUP BY doc_id),
r0 AS (SELECT page.*, coalesce(raw, 0) AS raw, coalesce(risks, 0)::INT AS risks, coalesce(high_risks, 0)::INT AS high_risks, coalesce(medium_risks, 0)::INT AS medium_risks, coalesce(n_findings, 0) AS n_findings
  FROM page LEFT JOIN sums USING (doc_id) LEFT JOIN counts USING (doc_id)),
r1 AS (SELECT *, CASE WHEN is_likely_policy_page THEN greatest(0, least(100, floor(raw + CASE WHEN risks > 0 AND confidence = 'High' THEN 4 WHEN risks > 0 AND confidence = 'Low' THEN -4 ELSE 0 END + 0.5))) ELSE 0 END::INT AS risk_score,
  CASE WHEN is_likely_policy_page THEN risks ELSE 0 END::INT AS issues_count,
  CASE WHEN NOT is_likely_policy_page THEN CASE WHEN linked THEN 'policy-link' ELSE 'none' END WHEN high_risks > 0 THEN 'high-risk' WHEN medium_risks > 0 THEN 'policy-risk' ELSE 'policy' END AS level_hint,
  CASE WHEN NOT is_likely_policy_page THEN CASE WHEN linked THEN 'Likely policy link found' ELSE 'No policy detected' END WHEN high_risks > 0 THEN 'High privacy concern' WHEN medium_risks > 0 THEN 'Potential privacy concerns' WHEN n_findings > 0 THEN 'Low-impact findings only' ELSE 'Privacy policy detected' END AS risk_summary FROM r0),
r2 AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'red' WHEN risk_score >= 35 THEN 'yellow' ELSE 'blue' END AS level,
  risk_summary || ': ' || issues_count || CASE WHEN issues_count = 1 THEN ' risk flagged' ELSE ' risks flagged' END AS flagged FROM r1),
risk AS (SELECT *, CASE WHEN issues_count > 0 THEN least(issues_count, 99)::VARCHAR ELSE '' END AS badge_text, CASE level WHEN 'red' THEN '#D93025' WHEN 'yellow' THEN '#F9AB00' ELSE '#1A73E8' END AS badge_color,
  CASE level_hint WHEN 'policy-link' THEN 'Likely privacy policy link found — click to review' WHEN 'policy' THEN CASE WHEN issues_count > 0 THEN flagged ELSE 'Privacy policy detected — no major risks flagged' END
    WHEN 'policy-risk' THEN flagged || ' — click to review' WHEN 'high-risk' THEN flagged || ' — click to review' ELSE 'No policy detected yet' END AS toolbar_title FROM r2)"""
RESULTS = ",\n".join((FOUND, DOC_SCORE_OF, CATS_OF, LEGACY_OF, WHOLE_OF, RISK_OF))


#: Character references of the pages.
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def plain(x: str) -> str:
    for tag in SILENT:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?</{tag}\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)</?(?:{'|'.join(sorted(FLOW))})(?:\s[^>]*)?>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for reference, character in REFERENCES:
        x = f"replace({x}, {q(reference)}, {q(character)})"
    return norm(x)


_TITLE = case([(f"page_id % {len(corpus.TITLES)} = {k}", f"<title>{t}</title>" if t else "") for k, t in enumerate(corpus.TITLES)], "")
PAGES = rf"""p0 AS (SELECT page_id, url, replace(replace(html, '</nav>', {pick('page_id', corpus.NAV_LINKS)} || '</nav>'), '</footer>', {pick('page_id', corpus.FOOTER_LINKS)} || '</footer>') AS h, {_TITLE} AS t FROM pages),
aug AS (SELECT page_id, url, replace(CASE WHEN t = '' THEN h ELSE regexp_replace(h, '<title>[^<]*</title>', t, 'g') END, '</article>', '<p>' || {pick('page_id', corpus.SEEDS)} || '</p></article>' || {pick('page_id', corpus.EXTRAS)}) AS html FROM p0)"""
_all = lambda pattern: f"regexp_extract_all(html, {q('(?is)' + pattern)}, 1)"
_MARKED = _all(r'<section class="x legal policy">(.*?)</section>')
_BLOCKS = [_all(r"<main\b[^>]*>(.*?)</main\s*>"), _all(r"<article\b[^>]*>(.*?)</article\s*>"), _all('<div role="main">(.*?)</div>'), _MARKED, _MARKED, _all('<div class="content">(.*?)</div>')]
TEXTS_OF = rf"""t0 AS (SELECT page_id, list_concat({', '.join(_BLOCKS)}) AS l FROM aug),
t1 AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM t0),
t2 AS (SELECT page_id, pos, {plain('x')} AS block FROM t1),
t3 AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS blocks FROM t2 WHERE length(block) >= {rules.LEAST_BLOCK} GROUP BY page_id),
b0 AS (SELECT page_id, url, {plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {plain(r"regexp_extract(html, '(?is)<body\b[^>]*>(.*)', 1)")} AS body, left({plain("regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ' ', 'g')")}, {rules.MAX_TEXT}) AS full_text FROM aug),
b1 AS (SELECT page_id, url, title, full_text, left(coalesce(blocks, body), {rules.MAX_TEXT}) AS main_text FROM b0 LEFT JOIN t3 USING (page_id)),
texts AS (SELECT *, CASE WHEN main_text <> '' THEN main_text ELSE full_text END AS page_text FROM b1)"""
_A = q(r"""(?is)<a\b[^>]*?href=("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)</a>""")
_FRAMES = " || ' ' || ".join(f"array_to_string(regexp_extract_all(html, {q('(?is)' + p)}), ' ')" for p in (r"<nav\b[^>]*>.*?</nav\s*>", r"<footer\b[^>]*>.*?</footer\s*>", '<div class="footer">.*?</div>'))
ANCHORS_OF = rf"""a0 AS (SELECT page_id, url, html, regexp_extract_all(html, {_A}) AS l, {_FRAMES} AS framed FROM aug),
a1 AS (SELECT page_id, url, framed, unnest(l) AS a, (generate_subscripts(l, 1) - 1)::INT AS pos FROM a0),
a2 AS (SELECT page_id, url, pos, regexp_replace(regexp_extract(a, {_A}, 1), {q('^["' + chr(39) + ']|["' + chr(39) + ']$')}, '', 'g') AS href,
  coalesce(nullif({plain(f"regexp_extract(a, {_A}, 2)")}, ''), regexp_extract(a, 'aria-label="([^"]*)"', 1)) AS text, contains(framed, a) AS in_nav FROM a1)"""
_BASE = r"regexp_extract(url, '^([^?#]*)', 1)"
_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
ANCHORS_OF += rf""",
a3 AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href WHEN starts_with(href, '/') THEN {_ORIGIN} || href
    WHEN href = '' THEN url WHEN starts_with(href, '?') THEN {_BASE} || href WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href
    ELSE regexp_extract({_BASE} || CASE WHEN {_BASE} = {_ORIGIN} THEN '/' ELSE '' END, '^(.*/)', 1) || href END AS direct FROM a2),
anch AS (SELECT page_id, url, pos, href, text, in_nav, array_to_string(list_transform(string_split(regexp_replace(direct, '/[^/]+/\.\./', '/', 'g'), ''), lambda c: CASE WHEN ord(c) > 126 OR c = ' ' THEN url_encode(c) ELSE c END), '') AS absolute, lower(text || ' ' || href) AS hay FROM a3)"""
LINKS_OF = rf"""links AS (SELECT * FROM (SELECT page_id, pos, absolute, (6 * {count('hay', rules.HIGH_LINK)} + 3 * {count('hay', rules.MEDIUM_LINK)} + {count('hay', rules.LOW_LINK)} + {case([(has('absolute', p), n) for p, n in rules.URL_POINTS], 0)} + in_nav::INT)::INT AS link_score
  FROM anch WHERE NOT regexp_matches(absolute, '^(javascript|mailto|tel):')) WHERE link_score > 0),
top AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY link_score DESC, pos) = 1)"""
#: The pages as documents, with their best link.
PAGE_DOCS = f"""{PAGES},
{TEXTS_OF},
{ANCHORS_OF},
{LINKS_OF},
docs AS (SELECT page_id AS doc_id, page_text AS text, title, url, coalesce(absolute, '') AS link, coalesce(link_score, 0) >= {rules.STRONG_LINK} AS linked FROM texts LEFT JOIN top USING (page_id))"""
PAGE_RESULTS = RESULTS.replace(DOCS, PAGE_DOCS, 1)

EVENTS = """ev AS (SELECT user_id AS tab_id, ts, event_id AS seq, CASE WHEN event_id % 8 < 4 THEN 'heuristicResult' WHEN event_id % 8 < 6 THEN 'loading' WHEN event_id % 8 = 6 THEN 'removed' ELSE 'getHeuristic' END AS type,
  CASE WHEN event_id % 3 = 0 THEN 'https://site.example/' || event_type END AS url, props AS payload, value FROM events),
lastchange AS (SELECT * FROM ev WHERE type = 'heuristicResult' OR type = 'removed' OR (type = 'loading' AND url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, seq DESC) = 1)"""
REQUESTS_OF = """lim AS (SELECT *, (row_number() OVER (PARTITION BY tab_id, date_trunc('day', ts) ORDER BY ts, seq))::INT AS rank_in_window FROM ev),
req AS (SELECT *, rank_in_window > 3 AS limited, CASE WHEN seq % 5 = 0 THEN 'wrong' WHEN seq % 7 = 0 THEN NULL ELSE 'right' END AS token,
  CASE WHEN seq % 11 = 0 THEN '  ' || chr(10) || ' ' WHEN seq % 13 = 0 THEN repeat('long ', 10001) WHEN seq % 17 = 0 THEN NULL ELSE payload END AS text, CASE WHEN seq % 19 <> 0 THEN seq % 4 <> 0 END AS enabled FROM lim)"""


def _gate(*steps: tuple[str, int, str]) -> str:
    return f"{case([(c, n) for c, n, _ in steps], 200)}::INT AS status, (CASE " + " ".join(f"WHEN {c} THEN '{e}'" for c, _, e in steps) + " END) AS error"


_LIMITED, _TOKEN = ("limited", 429, "rate_limited"), ("coalesce(token, '') <> 'right'", 401, "unauthorized")
_TEXT_GATES = (r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = ''", 400, "missing_text"), (f"length(coalesce(text, '')) > {MOST_TEXT}", 413, "text_too_large")
_CHECK = ", ".join(f"({i}, {q(k)}, {q(label)}, {q(message)})" for i, (k, (label, message)) in enumerate(rules.CHECKLIST.items()))
_LABEL = lambda x, table: "(CASE " + " ".join(f"WHEN {x} = '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {x} END)"
_REPORT_OF = "cards AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS p FROM whole WHERE count_as_risk AND doc_id IN (SELECT doc_id FROM page WHERE is_likely_policy_page) QUALIFY p < 6)"


def sql() -> dict[str, str]:
    with_ = lambda tables, select: f"WITH {tables}\n{select}"
    empty = lambda policy, other: f"CASE WHEN is_likely_policy_page THEN {q(policy)} ELSE {q(other)} END"
    one = "CASE WHEN risks = 1 THEN ' risk' ELSE ' risks' END"
    return {
        "sentence_split": with_(SENT, "SELECT doc_id, i, sentence FROM sent"),
        "chunk_windows": with_(UNITS, "SELECT doc_id, ord, unit FROM units"),
        "snippet_shorten": with_(UNITS, f"SELECT doc_id, ord, {shorten('unit')} AS snippet, {compare_key('unit')} AS key FROM units"),
        "pattern_hits_page_hints": with_(DOCS, f"SELECT doc_id, {count('text', rules.STRONG_PAGE)} AS strong, {count('text', rules.WEAK_PAGE)} AS weak FROM docs"),
        "page_text_extract": with_(f"{PAGES},\n{TEXTS_OF}", "SELECT page_id, title, main_text, full_text FROM texts"),
        "page_policy_score": with_(f"{PAGES},\n{TEXTS_OF}", f"SELECT page_id, page_score, {_DISPLAY} FROM (SELECT page_id, {page_score('page_text', 'title', 'url')}::INT AS page_score FROM texts)"),
        "anchor_scan": with_(f"{PAGES},\n{ANCHORS_OF}", "SELECT page_id, pos, href, text, in_nav, absolute FROM anch"),
        "address_spellings": "WITH p AS (SELECT page_id, url, split_part(url, ':', 1) AS scheme, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*/(.*)$', 1) AS rest FROM pages),\n"
        "s(pos) AS (VALUES (0), (1), (2), (3), (4), (5))\n"
        "SELECT page_id, pos::INT AS pos, CASE pos WHEN 0 THEN upper(scheme) || '://' || upper(host) || '/' || rest WHEN 1 THEN scheme || '://' || host || CASE WHEN scheme = 'https' THEN ':443/' ELSE ':80/' END || rest "
        r"WHEN 2 THEN scheme || ':\\' || host || '\x\.\%2e%2E\' || rest WHEN 3 THEN ' ' || scheme || '://' || chr(9) || host || '/../' || rest || chr(10) WHEN 4 THEN '//' || host || '/' || rest ELSE './a/../../../../../../' || rest END AS href, url AS absolute FROM p CROSS JOIN s",
        "link_score": with_(f"{PAGES},\n{ANCHORS_OF},\n{LINKS_OF}", "SELECT page_id, pos, absolute, link_score FROM links"),
        "best_policy_link": with_(
            f"{PAGES},\n{ANCHORS_OF},\n{LINKS_OF}",
            "SELECT page_id, coalesce(absolute, '') AS best_policy_link, coalesce(link_score, 0)::INT AS best_link_score FROM pages LEFT JOIN top USING (page_id)",
        ),
        "best_policy_link_of_rows": with_(f"{PAGES},\n{ANCHORS_OF},\n{LINKS_OF}", "SELECT page_id, absolute AS best_policy_link, link_score AS best_link_score FROM top"),
        "category_flags": with_(f"{SENT},\n{CATS_OF}", f"SELECT doc_id, category, present, array_to_string(e, '{BAR}') AS evidence FROM cats"),
        "unit_context_flags": with_(f"{UNITS},\n{CONTEXT_OF}", "SELECT doc_id, ord, negation, permission_limited, safe_context, ad_tech FROM ctx WHERE negation OR permission_limited OR safe_context OR ad_tech"),
        "unit_evidence_score": with_(MATCHES, "SELECT doc_id, rule_ord, ord, strong_hits, medium_hits, ad_tech_hits, negated, permission_limited, safe_context, score FROM m"),
        "rule_hit_totals": with_(f"{MATCHES},\n{TOTALS}", "SELECT * FROM tot"),
        "evidence_ranked": with_(f"{MATCHES},\n{SNIPPETS_OF}", "SELECT doc_id, rule_ord, rank, ord, snippet FROM snip"),
        "findings_scored": with_(FOUND, "SELECT doc_id, place, category, title, summary, confidence, severity, score, evidence, count_as_risk FROM found"),
        "findings_merged": with_(FOUND, f"SELECT doc_id, string_agg(category || ':' || score, '{BAR}' ORDER BY place) AS findings FROM found GROUP BY doc_id"),
        "policy_results": with_(
            f"{FOUND},\n{DOC_SCORE_OF},\nagg AS (SELECT doc_id, count(*)::INT AS n, count_if(count_as_risk)::INT AS c, list(title ORDER BY place) FILTER (count_as_risk) AS t FROM found GROUP BY doc_id)",
            f"SELECT doc_id, is_likely_policy_page, page_score, score, confidence, CASE WHEN is_likely_policy_page THEN coalesce(n, 0) ELSE 0 END::INT AS n_findings, CASE WHEN is_likely_policy_page THEN coalesce(c, 0) ELSE 0 END::INT AS counted_risk_count, CASE WHEN is_likely_policy_page THEN coalesce(array_to_string(t[1:{rules.MAX_REASONS}], '{BAR}'), '') ELSE '' END AS reasons FROM page LEFT JOIN agg USING (doc_id)",
        ),
        "page_results": with_(
            f"{PAGE_RESULTS},\nagg AS (SELECT doc_id, count_if(count_as_risk)::INT AS c, list(title ORDER BY place) FILTER (count_as_risk) AS t FROM own GROUP BY doc_id)",
            f"SELECT doc_id AS page_id, score, confidence, link AS best_policy_link, coalesce(c, 0)::INT AS counted_risk_count, risk_score, level, level_hint, toolbar_title, coalesce(array_to_string(t[1:{rules.MAX_REASONS}], '{BAR}'), '') AS reasons FROM risk LEFT JOIN agg USING (doc_id)",
        ),
        "risk_scores": with_(RESULTS, "SELECT doc_id, risks, high_risks, medium_risks, risk_score, issues_count, level_hint, risk_summary, level, badge_text, badge_color, toolbar_title FROM risk"),
        "legacy_findings": with_(f"{SENT},\n{CATS_OF},\n{LEGACY_OF}", f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, category, title, confidence, severity, score, count_as_risk, source_key, array_to_string(e, '{BAR}') AS evidence FROM lf"),
        "findings_report": with_(
            f"{RESULTS},\n{_REPORT_OF}",
            f"SELECT doc_id, p AS pos, title, {_LABEL('confidence', rules.CONFIDENCE_LABEL)} || ' • ' || {_LABEL('severity', rules.SEVERITY_LABEL)} AS meta, summary, CASE WHEN e1 IS NULL THEN '' ELSE 'Show evidence (' || CASE WHEN e2 IS NULL THEN 1 ELSE 2 END || ')' END AS evidence_label, coalesce(e1, '') || coalesce(chr(10) || e2, '') AS evidence FROM cards "
            f"UNION ALL SELECT doc_id, -1, {empty('No meaningful privacy risks were counted on this policy page.', 'Open the likely policy page to see counted privacy risks and full evidence.')}, '', '', '', '' FROM page WHERE doc_id NOT IN (SELECT doc_id FROM cards)",
        ),
        "reasons_report": with_(
            f"{RESULTS},\n{_REPORT_OF}",
            f"SELECT doc_id, p AS pos, title AS reason FROM cards UNION ALL SELECT doc_id, -1, {empty('No meaningful privacy risks were counted on this policy page.', 'Meaningful privacy risks are only counted when a likely privacy policy page is open.')} FROM page WHERE doc_id NOT IN (SELECT doc_id FROM cards)",
        ),
        "checklist_report": with_(
            f"{SENT},\n{DOC_SCORE_OF},\n{CATS_OF},\nlab(pos, category, label, message) AS (VALUES {_CHECK}),\nsomething AS (SELECT DISTINCT doc_id FROM cats WHERE present)",
            f"SELECT doc_id, lab.pos::INT AS pos, category, label, present AS checked, CASE WHEN present THEN CASE WHEN is_likely_policy_page THEN '{rules.PREFIX_POLICY}' ELSE '{rules.PREFIX_OTHER}' END || message ELSE '' END AS message, CASE WHEN present THEN 'Evidence: ' || array_to_string(e[1:2], ' • ') ELSE '' END AS quote FROM page JOIN something USING (doc_id) JOIN cats USING (doc_id) JOIN lab USING (category) "
            "UNION ALL SELECT doc_id, -1, 'note', 'Estimated from current page content. Open the likely policy page for full policy-based analysis.', false, '', '' FROM page JOIN something USING (doc_id) WHERE NOT is_likely_policy_page "
            f"UNION ALL SELECT doc_id, -1, 'note', {empty('Privacy policy detected, but no clear data-type signals were found.', 'No clear privacy-related data categories were estimated from this page.')}, false, '', '' FROM page WHERE doc_id NOT IN (SELECT doc_id FROM something)",
        ),
        "page_status": with_(
            RESULTS,
            f"SELECT doc_id, CASE WHEN NOT is_likely_policy_page THEN 'No likely policy link was found.' WHEN high_risks > 0 THEN risks || {one} || ' detected (' || high_risks || ' high-impact)' WHEN medium_risks > 0 THEN risks || {one} || ' detected' ELSE 'No major privacy risks detected' END AS status, "
            "CASE WHEN NOT is_likely_policy_page THEN 'status-blue' WHEN high_risks > 0 THEN 'status-red' WHEN medium_risks > 0 THEN 'status-yellow' ELSE 'status-green' END AS status_class, CASE WHEN is_likely_policy_page THEN '' ELSE 'Privacy policy not detected on this page.' END AS finder_status, "
            f"CASE WHEN NOT is_likely_policy_page THEN 'This page can still show estimated data categories below, but it is not being treated as the privacy policy.' WHEN risks > 0 THEN 'This policy shows ' || risks || ' meaningful privacy' || {one} || '. Review the findings below for the biggest concerns.' WHEN n_findings > 0 THEN 'This policy was detected, but only lower-impact or less certain findings were identified.' ELSE 'This appears to be the privacy policy, but no major privacy concerns were clearly detected.' END AS headline, "
            "'No policy link found' AS link_text, false AS link_enabled FROM risk",
        ),
        "risk_by_lang_source": with_(RESULTS, "SELECT lang, source, count(*) AS docs, sum(risk_score)::BIGINT AS risk_sum, sum(issues_count)::BIGINT AS issues, count_if(level = 'red')::BIGINT AS red FROM risk JOIN (SELECT doc_id, lang, source FROM docs) USING (doc_id) GROUP BY ROLLUP (lang, source)"),
        "latest_result_per_tab": with_(EVENTS, "SELECT tab_id, seq, payload FROM lastchange WHERE type = 'heuristicResult'"),
        "tab_resets": with_(EVENTS, f"SELECT tab_id, seq, '' AS badge_text, {q(rules.SCANNING)} AS toolbar_title FROM ev WHERE type = 'loading'"),
        "analysis_triggers": with_(
            EVENTS,
            f"SELECT tab_id, seq, epoch_us(ts) AS due_us, seq % 5 = 0 AS immediate FROM ev WHERE seq % 5 < 4 UNION ALL SELECT tab_id, seq, epoch_us(ts) + {1000 * RECHECK_MS}, false FROM ev WHERE seq % 5 = 0",
        ),
        "stored_settings": with_(EVENTS, f"SELECT 'user.' || tab_id AS key, arg_max(coalesce(url, ''), seq) AS value FROM ev GROUP BY tab_id UNION ALL SELECT * FROM (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in DEFAULTS.items())})"),
        "toolbar_icons": with_(RESULTS, "SELECT doc_id, size, 'icons/' || level || size || '.png' AS path FROM risk CROSS JOIN (VALUES (16), (32), (48), (128)) s(size)"),
        "unscored_findings_risk": with_(
            f"{FOUND},\nw AS (SELECT doc_id, sum({_WEIGHT('category', rules.CATEGORY_WEIGHT, 10)} * {_WEIGHT('confidence', rules.CONFIDENCE_WEIGHT, 0.75)} * {_WEIGHT('severity', rules.SEVERITY_WEIGHT, 1.0)} + CASE WHEN s1 IS NOT NULL THEN 2 ELSE 0 END) AS raw FROM found WHERE count_as_risk GROUP BY doc_id)",
            "SELECT doc_id, round(coalesce(raw, 0), 6)::DOUBLE AS raw FROM docs LEFT JOIN w USING (doc_id)",
        ),
        "text_caps": with_(
            f"{PAGES},\ncut AS (SELECT page_id AS doc_id, left(repeat(url || ' is the address of the page.' || chr(10), 4000), {rules.MAX_TEXT}) AS text FROM aug),\n{sent('cut')}",
            "SELECT cut.doc_id AS page_id, any_value(length(text))::INT AS n_chars, count(i)::INT AS n_sentences, arg_max(sentence, i) AS last_sentence FROM cut LEFT JOIN sent USING (doc_id) GROUP BY cut.doc_id",
        ),
        "evicted_tabs": with_(EVENTS, "SELECT tab_id, seq FROM lastchange WHERE type <> 'heuristicResult'"),
        "tab_lookup": with_(EVENTS, "SELECT tab_id, payload FROM (SELECT DISTINCT tab_id FROM ev) LEFT JOIN (SELECT tab_id, payload FROM lastchange WHERE type = 'heuristicResult') USING (tab_id)"),
        "address_changes": with_(EVENTS, "SELECT tab_id, seq, url FROM (SELECT *, lag(url) OVER (PARTITION BY tab_id ORDER BY ts, seq) AS before FROM ev) WHERE before IS NOT NULL AND url IS NOT NULL AND url <> before"),
        "debounce_sessions": with_(
            f"{EVENTS},\nmarks AS (SELECT tab_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY tab_id ORDER BY ts) > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM ev),\nisl AS (SELECT *, sum(new) OVER (PARTITION BY tab_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM marks)",
            "SELECT tab_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM isl GROUP BY tab_id, g",
        ),
        "rate_limited_requests": with_(f"{EVENTS},\n{REQUESTS_OF}", "SELECT tab_id, seq, rank_in_window, limited FROM req"),
        "answer_delays": with_(
            EVENTS,
            "SELECT a.tab_id, a.seq AS asked_seq, r.seq AS result_seq, epoch_us(r.ts) - epoch_us(a.ts) AS delay_us FROM ev a JOIN ev r ON a.tab_id = r.tab_id AND r.ts >= a.ts AND r.ts <= a.ts + INTERVAL 6 HOURS WHERE a.type = 'loading' AND r.type = 'heuristicResult'",
        ),
        "unchanged_pages": "SELECT DISTINCT ON (url, html) url, length(html)::INT AS n_chars FROM (SELECT url, unnest([html, CASE WHEN page_id % 5 = 0 THEN html || ' ' ELSE html END]) AS html FROM pages)",
        "quota_windows": with_(
            f"RECURSIVE {EVENTS},\nstarts AS (SELECT tab_id, min(ts) AS start FROM ev GROUP BY tab_id UNION ALL SELECT s.tab_id, min(e.ts) FROM starts s JOIN ev e ON e.tab_id = s.tab_id AND e.ts >= s.start + INTERVAL 1 DAY GROUP BY s.tab_id)",
            "SELECT key, us, seq, n AS rank_in_window, n > 3 AS limited FROM (SELECT ev.tab_id::VARCHAR AS key, epoch_us(ev.ts) AS us, seq, row_number() OVER (PARTITION BY ev.tab_id, s.start ORDER BY ev.ts, seq) AS n FROM ev ASOF JOIN starts s ON ev.tab_id = s.tab_id AND ev.ts >= s.start)",
        ),
        "page_analyses": with_(
            f"""{EVENTS},
kinds AS (SELECT tab_id, ts, seq, url, CASE seq % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'load' WHEN 2 THEN 'mutation' END AS type FROM ev),
asked AS (SELECT tab_id, ts FROM kinds WHERE type IN ('load', 'mutation') UNION ALL SELECT tab_id, ts + INTERVAL 1200 MILLISECONDS FROM kinds WHERE type = 'ready'
  UNION ALL SELECT tab_id, ts FROM (SELECT *, lag(url) OVER (PARTITION BY tab_id ORDER BY ts, seq) AS before FROM kinds WHERE url IS NOT NULL) WHERE url <> before),
marks AS (SELECT tab_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY tab_id ORDER BY ts) > INTERVAL 900 MILLISECONDS THEN 1 ELSE 0 END AS new FROM asked),
isl AS (SELECT *, sum(new) OVER (PARTITION BY tab_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM marks)""",
            "SELECT tab_id, epoch_us(max(ts)) + 900000 AS due_us, count(*) AS n, false AS immediate FROM isl GROUP BY tab_id, g UNION ALL SELECT tab_id, epoch_us(ts), 1, true FROM kinds WHERE type = 'ready'",
        ),
        "request_gate": with_(f"{EVENTS},\n{REQUESTS_OF}", f"SELECT tab_id, seq, {_gate(_LIMITED, _TOKEN, ('NOT coalesce(enabled, false)', 403, 'disabled'), *_TEXT_GATES, ('NOT seq % 23 <> 0', 500, 'missing_openai_api_key'))} FROM req"),
        "admin_gate": with_(f"{EVENTS},\n{REQUESTS_OF}", f"SELECT tab_id, seq, status, error, CASE WHEN status = 200 THEN coalesce(enabled, false) END AS set_enabled FROM (SELECT tab_id, seq, enabled, {_gate(_LIMITED, _TOKEN)} FROM req)"),
        "client_gate": with_(
            f"{EVENTS},\n{REQUESTS_OF}",
            "SELECT tab_id, seq, e AS client_error, CASE WHEN e IS NOT NULL THEN 0 ELSE CASE WHEN text IS NULL THEN 2 ELSE length(to_json({'text': text})::VARCHAR) END END::INT AS body_length FROM (SELECT *, CASE WHEN NOT coalesce(enabled, false) THEN 'Analyzer is disabled. Turn it on first.' WHEN coalesce(token, '') = '' THEN 'Missing Extension Token. Paste it in the popup settings.' END AS e FROM req)",
        ),
        "client_replies": with_(
            EVENTS,
            "SELECT seq, status, status BETWEEN 200 AND 299 AS ok, CASE WHEN status <> 200 THEN CASE WHEN seq % 3 = 0 THEN 'disabled' ELSE 'HTTP ' || status END END AS reply_error FROM (SELECT seq, CASE WHEN seq % 4 = 0 THEN 200 WHEN seq % 4 = 1 THEN 403 ELSE 500 END::INT AS status FROM ev)",
        ),
        "message_dispatch": with_(EVENTS, "SELECT CASE type WHEN 'heuristicResult' THEN 'store' WHEN 'getHeuristic' THEN 'lookup' ELSE 'ignored' END AS handler, count(*) AS n FROM ev GROUP BY ALL"),
        "llm_json_salvage": with_(
            f"{EVENTS},\nreplies AS (SELECT seq, CASE seq % 6 WHEN 0 THEN payload WHEN 1 THEN 'Here it is: ' || payload || ' Done.' WHEN 2 THEN payload || ' and ' || payload WHEN 3 THEN 'null' WHEN 4 THEN 'no json at all' ELSE '' END AS output FROM ev),\n"
            r"tried AS (SELECT seq, output, try_cast(output AS JSON) AS whole, try_cast(regexp_extract(output, '(?s)\{.*\}') AS JSON) AS part FROM replies)",
            "SELECT seq, ok AS is_json, CASE WHEN NOT ok THEN output END AS raw FROM (SELECT seq, output, coalesce(coalesce(nullif(whole::VARCHAR, ''), nullif(part::VARCHAR, '')) NOT IN ('null', 'false', '0', '\"\"'), false) AS ok FROM tried)",
        ),
        "llm_call_offline": with_(
            f"{EVENTS},\n{REQUESTS_OF}",
            f"SELECT request_id, status, error, 'low' AS overall_risk FROM (SELECT seq AS request_id, {_gate(_LIMITED, _TOKEN, ('NOT coalesce(enabled, false)', 403, 'disabled'), *_TEXT_GATES)} FROM req) WHERE status = 200",
        ),
        "llm_response_text": with_(EVENTS, "SELECT seq, CASE seq % 3 WHEN 0 THEN 'a' || seq WHEN 1 THEN 'b' ELSE '' END AS output FROM ev"),
    }
