import pytest
from pyspark.sql import functions as F

from discern.sources.addresses import address, resolve

BASE = 'https://a.example/dir/page?x=1#y'
CASES = [
    ('HTTP://EXAMPLE.com:80/a/./b/../c', BASE, 'http://example.com/a/c'),
    ('https:\\\\x.example\\a\\b', BASE, 'https://x.example/a/b'),
    ('//b.example:443/p', BASE, 'https://b.example/p'),
    ('/a b?c d#e f', BASE, 'https://a.example/a%20b?c%20d#e%20f'),
    ('q', BASE, 'https://a.example/dir/q'),
    ('?z', BASE, 'https://a.example/dir/page?z'),
    ('#t', BASE, 'https://a.example/dir/page?x=1#t'),
    ('', BASE, 'https://a.example/dir/page?x=1'),
    ('..', BASE, 'https://a.example/'),
    ('../../..', BASE, 'https://a.example/'),
    ('%2e%2E/x', BASE, 'https://a.example/x'),
    ('http://1.2.3', None, 'http://1.2.0.3/'),
    ('http://0x7f.1', None, 'http://127.0.0.1/'),
    ('http://256.1.1.1', None, None),
    ('http://[::1]:8080/', None, 'http://[::1]:8080/'),
    ('http://[1:0:0:2::3]/', None, 'http://[1:0:0:2::3]/'),
    ('http://[bad', BASE, None),
    ('http://a b/', BASE, None),
    ('http://ex%41mple.com', None, 'http://example.com/'),
    ('http://bücher.example/ü', None, 'http://xn--bcher-kva.example/%C3%BC'),
    ('mailto:x@a y', BASE, 'mailto:x@a y'),
    ('javascript:void(0)', BASE, 'javascript:void(0)'),
    ('data:text/plain,a b', None, 'data:text/plain,a b'),
    ('https:foo', BASE, 'https://a.example/dir/foo'),
    ('https:/foo', BASE, 'https://a.example/foo'),
    ('http:foo', BASE, 'http://foo/'),
    (' \t/p\n/q ', BASE, 'https://a.example/p/q'),
    ('http://u:p@h.example/', None, 'http://u:p@h.example/'),
    ('http://u@@h.example/', None, 'http://u%40@h.example/'),
    ('foo', None, None),
    ('foo', 'mailto:x', None),
    ('#f', 'mailto:x', 'mailto:x#f'),
    ('foo://Host/a/../b', None, 'foo://Host/b'),
    ('foo:/a/../../b', None, 'foo:/b'),
    ('file:///a/../b', None, 'file:///b'),
    ('http://h:99999/', None, None),
    ('http://h:/', None, 'http://h/'),
    ('http://:80', None, None),
    ('https://x.example', None, 'https://x.example/'),
    ('https://x.example?q', None, 'https://x.example/?q'),
    ('web+x:/..//p', None, 'web+x:/.//p'),
    ("http://h/?'", None, 'http://h/?%27'),
    ('http://h/^{}|', None, 'http://h/%5E%7B%7D|'),
    (None, BASE, None),
    ('http://h:080/', None, 'http://h/'),
    ('http://user:@h/', None, 'http://user@h/'),
    ('foo://h', None, 'foo://h'),
    ('http://09.1', None, None),
    ('http://h:8a/', None, None),
    ("file:x", "file:///a/b", "file:///a/x"),
    ("file://localhost/a", None, "file:///a"),
    ("///x/y", BASE, "https://x/y"),
    ("http://[::ffff:1.2.3.4]/", None, "http://[::ffff:102:304]/"),
    ("http://[0:0:1:0:0:0:1:0]/", None, "http://[0:0:1::1:0]/"),
    ("?q", "https://x.example", "https://x.example/?q"),
    ("http://a%2fb/", None, None),
    ("\U0001f600", BASE, "https://a.example/dir/%F0%9F%98%80"),
]


@pytest.mark.parametrize("href, base, want", CASES)
def test_cases(href, base, want):
    assert resolve(href, base) == want
    if want is not None:
        assert resolve(want) == want  # a normalised address stays


def test_columns(spark):
    rows = spark.createDataFrame([(k, h, b) for k, (h, b, _) in enumerate(CASES)], "k int, href string, base string")
    got = {r["k"]: (r["x"], r["y"]) for r in rows.select("k", address(F.col("href"), F.col("base")).alias("x"), address(F.col("href")).alias("y")).collect()}
    assert got == {k: (w, resolve(h)) for k, (h, _, w) in enumerate(CASES)}
    assert rows.where("k < 0").select(address(F.col("href")).alias("x")).collect() == []
