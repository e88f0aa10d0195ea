import pytest
from pyspark.sql import functions as F

from discern.operators import findings
from discern.plans.analyze import analyze_texts, assess

RISKY = "biometric high 42 y; sale high 40 y; sensitive high 38 y; tracking high 34 y; sharing medium 28 y; location medium 26 y; financial medium 26 y; children low 14 n; retention low 12 n"
CASES = {
    1: ("Privacy Policy", "https://a.example/privacy-policy", "This Privacy Policy explains how we collect personal information. We use cookies to remember your preferences on this site.", 25, "High", 10, "tracking possible high 26 n", 0, "policy"),
    2: ("Privacy Notice", "https://a.example/legal", "Our privacy notice covers personal data that we hold. Our ad networks deliver ads across the whole web.", 18, "High", 9, "; ".join(f"{p.split()[0]} explicit {' '.join(p.split()[1:])}" for p in RISKY.split("; ")), 100, "high-risk"),
    3: ("Privacy", "https://a.example/privacy", "We do not sell personal information to anyone at all. This privacy policy applies to personal data.", 23, "High", 10, "sale explicit high 40 y", 71, "high-risk"),
    4: ("Privacy", "https://a.example/privacy", "We collect your precise location with your permission only. Read this privacy policy for more detail.", 13, "Medium", 7, "location explicit low 19 n", 0, "policy"),
    5: ("Shop", "https://a.example/shop", "Welcome to the shop, we have many fine things. Payment by credit card is accepted at checkout.", 0, "Low", 0, "financial possible medium 16 n", 0, "none"),
    6: ("Privacy", "https://a.example/privacy", "Your personal information includes your biometric information today.", 17, "High", 9, "biometric likely high 38 y", 55, "high-risk"),
    7: ("Privacy", "https://a.example/privacy", "We use a session cookie and cookies only for authentication purposes. This privacy policy describes personal data.", 20, "High", 10, "identifiers possible low 8 n; tracking likely high 24 y", 37, "high-risk"),
    8: ("Privacy", "https://a.example/privacy", "We use cookies. GPS too.", 12, "Medium", 6, "", 0, "policy"),
    9: (None, None, None, 0, "Low", 0, "", 0, "none"),
}


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame([(k, v[0], v[1], v[2]) for k, v in CASES.items()], "doc_id long, title string, url string, text string")
    return {r["doc_id"]: r for r in assess(analyze_texts(docs)).collect()}


@pytest.mark.parametrize("k", CASES)
def test_golden(results, k):
    _, _, _, page, confidence, score, found, risk, hint = CASES[k]
    r = results[k]
    assert (r["page_score"], r["confidence"], r["score"]) == (page, confidence, score)
    got = "; ".join(f"{f['category']} {f['confidence']} {f['severity']} {f['score']} {'y' if f['count_as_risk'] else 'n'}" for f in r["findings"])
    assert got == found
    assert all(len(f["evidence"]) == 1 for f in r["findings"])
    assert (r["risk_score"], r["level_hint"]) == (risk, hint)


def test_given_count_stays(results):
    assert results[7]["counted_risk_count"] == 0 and results[7]["issues_count"] == 1


def test_levels_and_toolbar(results):
    assert [results[k]["level"] for k in (2, 6, 1)] == ["red", "yellow", "blue"]
    assert results[2]["badge_text"] == "7" and results[1]["badge_text"] == ""
    assert results[2]["toolbar_title"] == "High privacy concern: 7 risks flagged — click to review"
    assert results[3]["toolbar_title"] == "High privacy concern: 1 risk flagged — click to review"


def test_overlapping_chunks_multiply_hits(spark):
    filler = [f"This is a filler sentence number {i} of the text." for i in range(6)]
    text = " ".join([*filler[:3], "We retain precise location for all users of it.", *filler[3:]])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = {r["category"]: r for r in findings.finding_rows(docs).collect()}
    assert findings.unit_rows(docs).count() == 18
    assert set(rows) == {"location", "retention"}
    totals = {r["rule_ord"]: r for r in findings.hit_totals(findings.matches(findings.rule_units(docs))).collect()}
    assert sorted((r["strong_hits"], r["medium_hits"]) for r in totals.values()) == [(0, 6), (6, 6)]
    assert (rows["location"]["confidence"], rows["retention"]["confidence"]) == ("explicit", "likely")


def test_row_order_does_not_matter(spark):
    docs = spark.createDataFrame([(k, *v[:3]) for k, v in CASES.items()], "doc_id long, title string, url string, text string")
    a = assess(analyze_texts(docs)).select("doc_id", "risk_score", F.to_json("findings").alias("f"))
    b = assess(analyze_texts(docs.orderBy(F.desc("doc_id")).repartition(3))).select("doc_id", "risk_score", F.to_json("findings").alias("f"))
    assert sorted(a.collect()) == sorted(b.collect())
