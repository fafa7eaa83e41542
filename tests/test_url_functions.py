from urllib.parse import parse_qsl, urlencode, urljoin

from pyspark.sql import functions as F

from pagemill.functions import urls as U

BASES = ["https://ferry.test/en/times", "http://a/b/c/d;p?q", "https://e.com", "https://e.com/x/", "http://h/a//b/"]
REFS = [
    "crew", "/winter", "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x", "", ".", "./", "..",
    "../g", "../..", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "g;x=1/../y", "http:g", "http:b/c",
    "a//b/../c", "mailto:q", "HTTPS://UP.com/x", "/a/..", "/.", "x/...", "/a/.b",
]


def test_resolve_equals_the_standard_library(spark):
    rows = [(b, r, urljoin(b, r)) for b in BASES for r in REFS]
    result = spark.createDataFrame(rows, "base string, ref string, expected string").withColumn(
        "got", U.url_resolve("base", "ref")
    )
    assert result.filter(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []


def test_requery_equals_the_standard_library(spark):
    cases = ["c", "a=1&b=2", "x=%zz", "a=b+c%20d", "t=~*-._", "=x", "&&a=&", "u=%C3%A9é€", "a=b=c", "p=100%", "%61=1"]
    rows = [(c, urlencode(parse_qsl(c, keep_blank_values=True))) for c in cases]
    result = spark.createDataFrame(rows, "q string, expected string").withColumn("got", U.requery("q")).collect()
    assert [(r["q"], r["got"]) for r in result] == rows


def test_normal_forms(spark):
    crawl = {
        "Http://FERRY.Test/Routes/Night/?z=9&k=&c=4": "http://ferry.test/Routes/Night?c=4&k=&z=9",
        "http://ferry.test": "http://ferry.test/",
        "http://u@H.com:80/a//b/#x": "http://u@h.com:80/a/b",
        "ferry.test/x": "https:///ferry.test/x",
        "http://[bad": None,
        "http://h/a?b=1&a=2&a=1&utm_x=3": "http://h/a?a=1&a=2&b=1&utm_x=3",
    }
    rows = spark.createDataFrame([(u,) for u in crawl], "u string").select("u", U.normalize_url("u").alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == crawl
    found = {
        ("/quay?side=w&utm_medium=m&deck=1", "https://ferry.test/en"): "https://ferry.test/quay?side=w&deck=1",
        ("tel:5550", "https://ferry.test"): None,
        ("crew", "https://ferry.test/en/times"): "https://ferry.test/en/crew",
        ("/quay/index.html", "https://ferry.test"): "https://ferry.test/quay/index.html",
        (" /INDEX ", "https://example.com/a"): "https://example.com/",
        ("http://[bad", "https://example.com"): None,
        ("x\ny", "https://example.com/"): "https://example.com/xy",
    }
    rows = spark.createDataFrame(list(found), "r string, b string").select("r", "b", U.normalize_link("r", "b").alias("n")).collect()
    assert {(r["r"], r["b"]): r["n"] for r in rows} == found


def test_paths(spark):
    cases = [
        ("https://ferry.test", "index.md", "file.bin"),
        ("https://ferry.test/night/board.htm", "night/board.md", "night/board.htm"),
        ("https://ferry.test/scans/Deck Plan(B).TIF", "scans/Deck-Plan-B.md", "scans/Deck-Plan-B.tif"),
        ("https://x.y/v1.2", "v1.md", "v1.2"),
        ("https://x.y/hulls/7.4.2", "hulls/7.md", "hulls/7.4.2"),
        ("https://x.y/a/../b", "a/index/b.md", "a/index/b"),
    ]
    rows = spark.createDataFrame(cases, "u string, page string, asset string").select(
        "u", U.url_to_rel_path("u", ".md").alias("p"), U.asset_rel_path("u").alias("a")
    ).collect()
    assert [tuple(r) for r in rows] == cases


def test_domains_and_patterns(spark):
    one = spark.range(1)

    def check(column):
        return one.select(column).first()[0]

    def arr(*items):
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    assert check(U.is_internal(F.lit("https://www.quay.example/path"), arr("quay.example")))
    assert check(U.is_internal(F.lit("https://quay.example/path"), arr("www.quay.example")))
    assert not check(U.is_same_domain(F.lit("https://quay.example/path"), arr("www.quay.example")))
    assert not check(U.is_same_domain(F.lit("https://dock.example:81/"), arr("dock.example:81")))
    assert not check(U.is_internal(F.lit("https://xquay.example/"), arr("quay.example")))
    url = F.lit("https://e.com/a/b.c?x=[1]")
    for glob, hit in [("*", 1), ("*/a/*", 1), ("/a/*", 0), ("*[[]1]", 1), ("*b?c*", 1), ("*[!0-9]?", 0), ("https://e.com/a/b.c?x=[[]1]", 1), ("*\\E*", 0)]:
        assert check(U.matches_patterns(url, arr(glob), arr())) == bool(hit), glob
        assert check(U.matches_patterns(url, arr(), arr(glob))) != bool(hit), glob


def test_dedup_key(spark):
    cases = {
        "https://e.com/": "https://e.com/", "https://e.com/a/": "https://e.com/a", "https://e.com/a": "https://e.com/a",
        "https://e.com/a/?x=/": "https://e.com/a?x=/", "https://e.com/?x=1": "https://e.com/?x=1", "https://e.com/a?x=b/": "https://e.com/a?x=b/",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", U.dedup_key("u").alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == cases
