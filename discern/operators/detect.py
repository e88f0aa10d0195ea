"""Is a page a disclosure page, and which of its links leads to one?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.patterns import computed_sql, evaluated, first_points, with_computed


def page_score(text: str, title: str, url: str) -> str:
    """Of a page's text, title and address; all of it SQL."""
    body = evaluated(text, lambda t: f"2 * {t.count(rules.STRONG_PAGE)} + {t.count(rules.WEAK_PAGE)}")
    head = evaluated(f"concat_ws(' ', {title}, {url})", lambda t: f"3 * {t.count(rules.STRONG_PAGE)} + {t.count(rules.WEAK_PAGE)}")
    return f"{body} + {head} + {first_points(url, rules.URL_POINTS)} + {first_points(title, rules.TITLE_POINTS)} + {first_points(text, [rules.TEXT_BONUS])}"


def page_confidence(score: Column) -> Column:
    return F.when(score >= 14, "High").when(score >= rules.POLICY_SCORE, "Medium").otherwise("Low")


def display_score(score: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(0), F.floor(score / 2 + 0.5))).cast("int")


def scored_pages(pages: DataFrame) -> DataFrame:
    """pages (title, url, page_text, ...) and page_score, score, confidence, is_likely_policy_page.

    Null url or title count as empty.
    """
    scored = computed_sql(pages, {"page_score": page_score("page_text", "coalesce(title, '')", "coalesce(url, '')")})
    total = F.col("page_score")
    return scored.withColumns({"score": display_score(total), "confidence": page_confidence(total), "is_likely_policy_page": total >= rules.POLICY_SCORE})


def link_score(link: str) -> str:
    """Of a link (text, href, absolute, in_nav): the name of a struct and a dot, or "" for columns; all of it SQL."""
    signal = evaluated(f"lower(concat_ws(' ', {link}text, {link}href))", lambda t: f"6 * {t.count(rules.HIGH_LINK)} + 3 * {t.count(rules.MEDIUM_LINK)} + {t.count(rules.LOW_LINK)}")
    return f"{signal} + {first_points(f'{link}absolute', rules.URL_POINTS)} + if({link}in_nav, 1, 0)"


def scored_links(links: DataFrame) -> DataFrame:
    """links (page_id, pos, href, text, in_nav, absolute) with link_score; scripts, mail and phone links go, links without an address, and scores of 0."""
    usable = links.where("absolute is not null").where(~F.col("absolute").rlike("^(javascript|mailto|tel):"))
    return computed_sql(usable, {"link_score": link_score("")}).where("link_score > 0")


def best_links(links: DataFrame) -> DataFrame:
    """(page_id, best_policy_link, best_link_score) from rows of links: the highest score, on ties the first in the page."""
    best = F.max_by(F.struct("absolute", "link_score"), F.struct("link_score", -F.col("pos")))
    return scored_links(links).groupBy("page_id").agg(best.alias("b")).select("page_id", F.col("b.absolute").alias("best_policy_link"), F.col("b.link_score").alias("best_link_score"))


def with_best_link(pages: DataFrame) -> DataFrame:
    """pages (links, ...) with best_policy_link ('' if there is none) and best_link_score in place of links; as best_links(), but inside the row."""

    usable = F.filter("links", lambda a: a["absolute"].isNotNull() & ~a["absolute"].rlike("^(javascript|mailto|tel):"))
    candidates = f"transform(__usable, (a, pos) -> named_struct('score', {link_score('a.')}, 'place', -pos, 'to', a.absolute))"
    rows = with_computed(pages, {"__usable": usable})
    rows = computed_sql(rows, {"__best": f"array_max(filter({candidates}, x -> x.score > 0))"})
    return rows.withColumns({"best_policy_link": F.coalesce("__best.to", F.lit("")), "best_link_score": F.coalesce("__best.score", F.lit(0))}).drop("__best", "__usable", "links")
