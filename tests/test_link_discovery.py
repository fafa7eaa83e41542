from pyspark.sql import functions as F

from pagemill.operators import links as L
from pagemill.sources.html_tree import html_nodes, parse_pages

SCHEMA = "page_id long, url string, html string, links_payload string"


def decide(make_responses, jobs, html, payload=None, url="https://example.com"):
    return L.page_decisions(parse_pages(make_responses((1, url, html, payload), schema=SCHEMA)), jobs)


def reasons(decided):
    rows = L.link_decisions(decided).orderBy(F.col("source").desc(), "pos").collect()
    return [(r["raw_url"], r["decision"], r["reason"]) for r in rows]


def test_tree_of_broken_html(make_responses):
    html = "<div><p>a<p>b<br>c</div></span><b>x &amp; &foo; &#233;</b><script>if (a < b) '</p>'</script><!-- c --><i class=A class='B'>"
    rows = html_nodes(parse_pages(make_responses((1, "https://e.com", html)))).orderBy("node_id").collect()
    assert [(r["tag"], r["depth"], r["end_id"], r["text"]) for r in rows] == [
        ("div", 0, 6, None), ("p", 1, 6, None), ("#text", 2, 2, "a"), ("p", 2, 6, None), ("#text", 3, 4, "b"), ("br", 3, 5, None),
        ("#text", 3, 6, "c"), ("b", 0, 8, None), ("#text", 1, 8, "x & &foo é"), ("script", 0, 10, None),
        ("#hidden", 1, 10, "if (a < b) '</p>'"), ("#comment", 0, 11, None), ("i", 0, 12, None),
    ]
    assert rows[-1]["attrs"] == {"class": "B"}


def test_filters_and_reasons(make_responses, make_jobs):
    html = '<a href="map.zip">Z</a><a href="#south">S</a><a href="tours/lake">L</a><a href="//rival.test/tours">R</a><a href="tours/old-fort">O</a>'
    decided = decide(make_responses, make_jobs({"start_url": "https://harbour.test", "allowed_domains": ["harbour.test"], "attachment_extensions": ["zip"], "exclude_patterns": ["*/old-*"]}), html,
                     '{"internal": [{"href": "/boats"}, {"href": "/old-boats"}]}', "https://harbour.test/en/")
    links = L.page_links(decided).first()
    assert sorted(links["internal_links"]) == ["https://harbour.test/boats", "https://harbour.test/en/tours/lake"]
    assert links["asset_links"] == ["https://harbour.test/en/map.zip"]
    stats = L.discovery_stats(decided).first()
    assert (stats["links_from_result"], stats["links_from_html_fallback"]) == (2, 5)
    by_address = {raw: reason for raw, _, reason in reasons(decided)}
    assert by_address["#south"] == "anchor-only" and by_address["//rival.test/tours"] == "external-domain"
    assert by_address["/old-boats"] == by_address["tours/old-fort"] == "excluded-by-pattern"


def test_repeats_keep_distinct_addresses(make_responses, make_jobs):
    html = '<a href="/quay/7?berth=b">1</a><a href="/quay/7">2</a><a href="/quay/8">3</a><a href="/quay/7/">4</a><a href="/quay/7?berth=c">5</a>'
    decided = decide(make_responses, make_jobs({}), html)
    assert [r for _, _, r in reasons(decided)] == ["kept", "kept", "kept", "duplicate-after-normalization", "kept"]


def test_assets_skip_domain_and_pattern_rules(make_responses, make_jobs):
    html = (
        '<link rel="canonical" href="/y"><a href="/fleet">F</a><img src="https://static.rival.test/ship.webp"><a href="/type.woff2">T</a>'
        '<a href="/plan.pdf?deck=2">P</a><p data-url="/k" data-href="/j"><link rel="stylesheet" href="/look.css">'
    )
    decided = decide(make_responses, make_jobs({"include_patterns": ["*/fleet", "*/[jky]"]}), html)
    assert sorted(reasons(decided)) == sorted([
        ("/y", "keep", "kept"), ("/fleet", "keep", "kept"), ("https://static.rival.test/ship.webp", "asset", "asset-like-url"),
        ("/type.woff2", "drop", "ignored-static-asset"), ("/plan.pdf?deck=2", "drop", "excluded-by-pattern"), ("/k", "keep", "kept"), ("/j", "keep", "kept"),
    ])


def test_payload_shapes(make_responses):
    payload = (
        '{"external":["tel:5550",{"url":"/ferry","href":null},{"href":"#deck"}],"misc":{"href":"/never"},'
        '"internal":[3.5,"https://harbour.test/crew/jobs",{"url":"https://harbour.test/log?utm_campaign=may"},{"href":"/prices"}]}'
    )
    parsed = parse_pages(make_responses((1, "https://harbour.test/", "", payload), (2, "https://e.com", "", "[1"), schema=SCHEMA))
    links = {r["page_id"]: sorted(r["payload_links"]) for r in L.extract_links(parsed).collect()}
    base = "https://harbour.test"
    assert links == {1: [f"{base}/crew/jobs", f"{base}/ferry", f"{base}/log", f"{base}/prices"], 2: []}


def test_same_result_for_any_partitioning_and_large_job_tables(make_responses, make_jobs, monkeypatch):
    rows = [(i, f"https://example.com/{i}", f'<a href="/x{i % 7}">x</a><a href="/x{i % 7}/">y</a>', None) for i in range(60)]
    parsed = parse_pages(make_responses(*rows, schema=SCHEMA))
    few = sorted(map(tuple, L.link_decisions(L.page_decisions(parsed.coalesce(1), make_jobs({}))).collect()))
    # Without the broadcast, the salted join must give the same.
    monkeypatch.setattr("pagemill.operators.scale.is_small", lambda *a, **k: False)
    many = sorted(map(tuple, L.link_decisions(L.page_decisions(parsed.repartition(16), make_jobs({}))).collect()))
    assert few == many and len(few) == 120
