"""The driver tables with disclosure phrases woven in, so that queries have something to find.

Everything is a function of the row's id, so another engine can build the same corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: Phrase k goes to the documents with doc_id % len(SEEDS) = k, and phrase k + SHIFT with it.
SEEDS = (
    "We use cookies, pixels, and similar technologies to measure engagement.",
    "We do not sell personal information to third parties.",
    "Our ad networks deliver ads based on your user activity.",
    "We collect your precise location with your permission.",
    "We retain records for as long as necessary and honor opt out requests.",
    "We share data with third parties and service providers.",
    "Credit card and billing information is processed at checkout.",
    "Nothing else is written in this line of text.",
    "We may collect biometric information such as a fingerprint or voiceprint.",
    "We process health information and your social security number.",
    "We do not knowingly accept children under 13 without parental consent.",
    "We use a session cookie for login, security and fraud prevention.",
    "We use cookies only to keep you signed in and never for anything else.",
    "We do not share your data unless you choose to, and partners act on our behalf.",
    "We may disclose in a sale of personal information some records to affiliates.",
    "The word café name appears beside énametag and also name alone here.",
    "We share your data with vendors who help us run many parts of the product, and we also share it with affiliates who build features; this sentence keeps going on purpose so that the snippet has to be cut, because it is well beyond two hundred and twenty characters long.",
    "We do not collect location data from any device at all.",
    "You may upload photos, videos, messages and other files as user content.",
    "We log your device id, browser type and operating system as diagnostic data.",
)
SHIFT = 7
#: Title and address of the documents with doc_id % 3 = k.
PAGES = (("Privacy Policy", "https://a.example/privacy-policy"), ("Legal notice", "https://b.example/legal"), ("Privacy", "https://c.example/privacy"))
#: Title, links in the navigation and links in the footer of the pages with page_id % len(TITLES) = k; empty: unchanged.
TITLES = ("", "Privacy Notice", "Terms and cookies", "", "Your Privacy &amp; Cookies")
NAV_LINKS = ('<a href="/legal">Legal</a>', "", '<a href="cookies">Cookie policy</a>', '<a href="mailto:privacy@a.example">Privacy policy</a>', '<a href="javascript:void(0)">Your privacy</a>')
FOOTER_LINKS = ('<a href="/privacy">Privacy Policy</a><a href="/privacy">Privacy Policy again</a>', '<a href="https://b.example/privacy-policy?x=1">Do not sell or share</a>', "", '<a href="//c.example/terms">Terms of service</a>', '<a class="x" href="?privacy=1">GDPR and CCPA</a>')
#: What follows the article of the pages with page_id % len(EXTRAS) = k: blocks of other selectors, and links in other spellings.
MORE = "<p>This second block of the page says more about the ways in which we use the information that you give to us.</p>"
EXTRAS = (
    "",
    f"<article>{MORE}</article>",
    f'<div role="main">{MORE}</div>',
    f'<section class="x legal policy">{MORE}</section>',
    "<div class=\"footer\"><a href='/privacy-center'>Privacy <b>cen</b>ter</a> <a href=/cookie-policy>Cookie policy</a><a href=\"/x/../privacy\" aria-label=\"Privacy policy\"></a></div>",
    '<div class="content"><p>Too short for a block.</p></div>',
)


def _pick(key, values, like=None):
    out = F
    for k, v in enumerate(values):
        out = out.when(key % len(values) == k, v)
    return out.otherwise(like if like is not None else "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, spread=name in ("documents", "pages"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, title, url) of all documents, each with its phrases in a last line."""
    phrases = [f"{s} {SEEDS[(k + SHIFT) % len(SEEDS)]}" for k, s in enumerate(SEEDS)]
    rows = table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit("\n"), _pick(F.col("doc_id"), phrases))
    return rows.select("doc_id", text.alias("text"), "lang", "source", _pick(F.col("doc_id"), [t for t, _ in PAGES]).alias("title"), _pick(F.col("doc_id"), [u for _, u in PAGES]).alias("url"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html) of all pages, with other titles, more links and more blocks."""
    rows = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    html = F.replace("html", F.lit("</nav>"), F.concat(_pick(k, NAV_LINKS), F.lit("</nav>")))
    html = F.replace(html, F.lit("</footer>"), F.concat(_pick(k, FOOTER_LINKS), F.lit("</footer>")))
    title = _pick(k, [f"<title>{t}</title>" if t else "" for t in TITLES])
    html = F.when(title == "", html).otherwise(F.regexp_replace(html, F.lit(r"<title>[^<]*</title>"), title))
    text = F.concat(F.lit("<p>"), _pick(k, SEEDS), F.lit("</p></article>"), _pick(k, EXTRAS))
    return rows.select("page_id", "url", F.replace(html, F.lit("</article>"), text).alias("html"))
