import time

import duckdb

from discern.operators import detect
from discern.plans import oracle
from discern.plans.queries import queries
from discern.sources.pages import anchors, parse_page, parsed_pages
from discern.sources.flags import read_flag, settings, store, stored, write_flag

LONG = "word " * 30
HTML = f"""<html><head><title> A &amp; B </title><style>p{{}}</style></head><body><nav><a href="/legal">Legal</a></nav>
<script>var a = "<p>no</p>";</script><main><p>One<p>Two {LONG}<b>bold</b>er</main><div class="policy x"><article>Art {LONG}</article></div>
<footer><a href="mailto:x@a.example">privacy policy</a><a href="/privacy" aria-label="Privacy policy"></a><a href="/privacy">Privacy policy</a></footer></body></html>"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_whole_tree_reader():
    page = parse_page(HTML, "https://a.example/x/y")
    assert page["title"] == "A & B"
    blocks = page["main_text"].split("\n\n")
    assert len(blocks) == 3 and blocks[0].startswith("One Two") and blocks[0].endswith("bolder")
    assert blocks[1] == blocks[2] == ("Art " + LONG).strip()  # article, then the block of its class: nested matches repeat
    assert [x["absolute"] for x in page["links"]] == ["https://a.example/legal", "mailto:x@a.example", "https://a.example/privacy", "https://a.example/privacy"]
    assert page["links"][2]["text"] == "Privacy policy" and all(x["in_nav"] for x in page["links"])
    assert parse_page(None, None)["page_text"] == ""


def test_hard_pages_take_linear_time():
    for html in ("<div>" * 50_000 + LONG, "<p><b>" * 30_000 + "</i>" * 30_000, '<a href="/x">x' * 30_000, "<main>" * 300 + LONG * 50):
        began = time.perf_counter()
        parse_page(html, "https://a.example/")
        assert time.perf_counter() - began < 10


def test_every_match_of_every_selector():
    page = parse_page(f"<body>B<article>A1 {LONG}</article><div role='main'>R {LONG}</div><article>A2 {LONG}</article><i class='legal policy'>P {LONG}</i><div class=content>short</div><div class=contents>N {LONG}</div>", None)
    assert [b.split()[0] for b in page["main_text"].split("\n\n")] == ["A1", "A2", "R", "P", "P"]


def test_links_in_all_spellings():
    html = "<nav><a href='/a'>O<b>n</b>e</a></nav><a href=/b>Two</a><div class='x footer'><p><a HREF=\"../c/../d\" aria-label=' Three '><img></a></div><a name=x>None</a><a href='http://[bad'>Four</a><a href=''>Five"
    got = [(x["href"], x["text"], x["in_nav"], x["absolute"]) for x in parse_page(html, "https://a.example/p/q?x=1")["links"]]
    assert got == [
        ("/a", "One", True, "https://a.example/a"), ("/b", "Two", False, "https://a.example/b"), ("../c/../d", "Three", True, "https://a.example/d"),
        ("http://[bad", "Four", False, None), ("", "Five", False, "https://a.example/p/q?x=1"),
    ]


def test_block_length(spark):
    rows = frame(spark, (1, "u", f"<body>B<article>{'x' * 100}</article></body>"), (2, "u", f"<body>B<article>{'x' * 101}</article></body>"), (3, None, None), (4, "u", ""))
    got = {r["page_id"]: r["page_text"] for r in parsed_pages(rows, "page_text").collect()}
    assert got == {1: "B " + "x" * 100, 2: "x" * 101, 3: "", 4: ""}
    assert parsed_pages(rows).columns == ["page_id", "url", "title", "main_text", "full_text", "page_text", "links"]


def test_resolution():
    base = "https://a.example/dir/page?x=1#y"
    for href, want in (("/p", "https://a.example/p"), ("//b.example/p", "https://b.example/p"), ("q", "https://a.example/dir/q"), ("?z", "https://a.example/dir/page?z"), ("#t", "https://a.example/dir/page?x=1#t"), ("http://c/", "http://c/"), ("mailto:x", "mailto:x"), (" /p/../r ", "https://a.example/r")):
        assert parse_page(f'<a href="{href}">x</a>', base)["links"][0]["absolute"] == want
    assert parse_page('<a href="/p">x</a>', "no address")["links"][0]["absolute"] is None


def test_references_without_semicolon(spark, tmp_path):
    html = "<title>a &amp;&amp</title><body><p>b &amp; &am; &notin; &#65; &#x42; &#67 &copy 1 &ampx; &quot<a href='/x?a=1&copy=2'>l&amp</a></body>"
    page, plain = parse_page(html, "https://a.example/"), parse_page(html, "https://a.example/", bare=False)
    assert page["title"] == "a &&" and page["full_text"] == 'b & &am; \u2209 A B C © 1 &x; "l&' and page["links"][0]["text"] == "l&"
    assert plain["title"] == "a &&amp" and plain["full_text"] == "b & &am; \u2209 A B &#67 &copy 1 &ampx; &quotl&amp" and plain["links"][0]["text"] == "l&amp"
    # the query on a page whose title was cut inside a reference, against its SQL
    frame(spark, (28, "https://a.example/", f"<html><head><title>x</title></head><body><article><h1>Ly &amp;&amp</h1><p>{LONG}</p></article></body></html>")).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["page_text_extract"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle.sql()["page_text_extract"]).fetchall()
    assert [tuple(r) for r in got] == want and "Ly &&amp word" in want[0][2]


def test_best_link_ties_and_junk(spark):
    html = '<nav><a href="/a">Privacy policy</a><a href="/b">Privacy policy</a></nav><a href="javascript:x">Privacy policy do not sell</a><a href="tel:1">Privacy notice</a>'
    rows = frame(spark, (1, "https://a.example/", html), (2, "https://a.example/", "<p>none</p>"), (3, None, html))
    got = {r["page_id"]: (r["best_policy_link"], r["best_link_score"]) for r in detect.with_best_link(parsed_pages(rows)).collect()}
    assert got == {1: ("https://a.example/a", 8), 2: ("", 0), 3: ("", 0)}
    assert detect.scored_links(anchors(rows)).count() == 2


def test_flag_and_settings(spark, tmp_path):
    path = str(tmp_path / "flag")
    assert [tuple(r) for r in read_flag(spark, path).collect()] == [(False,)]
    write_flag(spark, path, True)
    assert read_flag(spark, path).first()["enabled"] is True
    write_flag(spark, path, None)
    assert read_flag(spark, path).first()["enabled"] is False
    (tmp_path / "bad.json").write_text("not json")
    assert read_flag(spark, str(tmp_path / "bad.json")).first()["enabled"] is False
    assert {r["key"]: r["value"] for r in settings(spark).collect()} == {"analyzer.enabled": "false"}
    stored = spark.createDataFrame([("analyzer.enabled", "true", 2), ("analyzer.enabled", "false", 1), ("token", "t", 1)], "key string, value string, seq int")
    assert {r["key"]: r["value"] for r in settings(spark, stored).collect()} == {"analyzer.enabled": "true", "token": "t"}


def test_flag_file_is_indented(spark, tmp_path):
    write_flag(spark, str(tmp_path / "flag"), True)
    assert next((tmp_path / "flag").glob("part-*")).read_text() == '{\n  "enabled": true\n}\n'


def test_settings_are_stored(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert stored(spark, path).count() == 0
    assert settings(spark, stored(spark, path)).first()["value"] == "false"
    store(spark.createDataFrame([("token", "a", 1), ("analyzer.enabled", "true", 2)], "key string, value string, seq int"), path)
    store(spark.createDataFrame([("token", "b", 3)], "key string, value string, seq int"), path)
    assert {r["key"]: r["value"] for r in settings(spark, stored(spark, path)).collect()} == {"analyzer.enabled": "true", "token": "b"}
