import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions.nodes import text_of
from pagemill.functions.text import count_up_to, running
from pagemill.operators.content import check_mode, extract_content, extract_job_content, primary_container, strip_boilerplate
from pagemill.operators.markdown import html_text, to_markdown
from pagemill.sources.html_tree import parse_pages

LONG = "important content " * 10


def text(make_responses, html, mode="main"):
    chosen = extract_content(parse_pages(make_responses((1, "https://e.com", html))), mode)
    return chosen.select(text_of(F.col("content"))).first()[0]


def test_main_is_preferred_and_navigation_goes(make_responses):
    html = f"<html><body><header>Start</header><main><h1>Guide</h1><p>{LONG}</p></main><footer>Imprint</footer></body></html>"
    assert text(make_responses, html) == "Guide " + LONG.strip()
    assert "Start" in text(make_responses, html, "raw")


def test_aggressive_removes_related_blocks(make_responses):
    html = f'<body><div class="content"><p>{LONG}</p><div class="x related">Related links</div></div></body>'
    assert "Related" in text(make_responses, html)
    assert "Related" not in text(make_responses, html, "aggressive")


@pytest.mark.parametrize(
    "html, expected",
    [
        # Only the first match of a selector is tested; a later, longer one does not help.
        (f"<body><article>short</article><article><p>{LONG}</p></article><p>tail</p></body>", "short " + LONG.strip() + " tail"),
        # The order of the selectors counts, not the order on the page.
        (f'<body><div id="content"><p>{LONG}a</p></div><div class="entry-content"><p>{LONG}b</p></div></body>', LONG + "b"),
        # No selector: the longest substantial div; the first of two equal ones.
        (f"<body><div><p>{LONG}1</p></div><section><p>{LONG}2</p></section><div>{LONG * 2}</div></body>", LONG + "1"),
        # Text without a paragraph is not substantial.
        (f"<body><main>{LONG}</main>x</body>", LONG.strip() + " x"),
        # Boilerplate does not count, nested boilerplate is cut once.
        (f"<body><main><p>few</p><nav>{LONG}<aside>{LONG}</aside></nav></main><div><p>{LONG}</p></div></body>", LONG.strip()),
        # Not even a body: the page passes as it is, boilerplate included.
        ("<p>a</p><nav>b</nav>", "a b"),
    ],
)
def test_container_choice(make_responses, html, expected):
    assert text(make_responses, html) == expected


def test_modes(make_responses, make_jobs):
    html = f"<body><main><p>{LONG}</p></main><footer>f</footer></body>"
    pages = parse_pages(make_responses((1, "https://e.com", html)))
    raw = extract_job_content(pages, make_jobs({"content_extraction": "RAW"})).select(text_of(F.col("content"))).first()[0]
    assert raw.endswith("f")
    with pytest.raises(ValueError):
        check_mode("fancy")
    with pytest.raises(Exception, match="unknown content mode"):
        extract_job_content(pages, make_jobs({"content_extraction": "fancy"})).select("container_id").collect()


def markdown(make_responses, html):
    chosen = extract_content(parse_pages(make_responses((1, "https://e.com", html))), "raw")
    return to_markdown(chosen).first()["markdown"]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<h1>Title *x*</h1><h2>Two</h2><h4>Four</h4>", "Title \\*x\\*\n===========\n\nTwo\n---\n\n#### Four"),
        ("<p>a <b> b </b>c<strong></strong><em>d</em></p>", "a **b** c*d*"),
        ('<p><a href="/x" title="t">l</a> <a>no</a> <a href="/e"></a><img src="i.png" alt="A"></p>', '[l](/x "t") no ![A](i.png)'),
        ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><ol><li>x</li><li>y</li></ol>", "* a\n* b\n  + c\n\n1. x\n2. y"),
        ("<pre>a\n  b</pre><p>t<br>u</p><hr><blockquote>q</blockquote>", "```\na\n  b\n```\n\nt  \nu\n\n---\n\n> q"),
        ("<p><b>x<br><p>y</p></b>", "**x  \n\ny**"),
        ("<script>no</script><style>no</style><!-- no --><p>yes</p>", "yes"),
        ("", ""),
    ],
)
def test_markdown(make_responses, html, expected):
    assert markdown(make_responses, html) == expected


def test_html_text_round_trip(make_responses):
    html = '<p class="a&quot;b">x &lt; y<br/><i>z</i></p>'
    pages = parse_pages(make_responses((1, "https://e.com", html)))
    assert pages.select(html_text(F.col("nodes"))).first()[0] == html


def test_many_cuts_do_not_square_the_time(spark, make_responses):
    def seconds(n):
        html = "<body>" + "".join(f"<div><p>{LONG}{k}</p><nav>x<aside>{LONG}</aside></nav></div>" for k in range(n)) + "</body>"
        parsed = parse_pages(make_responses((1, "https://e.com", html))).persist()
        parsed.count()
        best = float("inf")
        for _ in range(3):
            started = time.perf_counter()
            row = primary_container(strip_boilerplate(parsed)).selectExpr("size(cuts) AS cuts", "container.tag AS tag").first()
            best = min(best, time.perf_counter() - started)
        parsed.unpersist()
        assert (row.cuts, row.tag) == (n, "div")
        return best

    assert seconds(16_000) < 2 * seconds(8_000) + 1


def test_running_totals_and_search_in_arrays(spark):
    values = [[], [5], [3, 1, 4, 1, 5, 9, 2, 6], list(range(0, 300, 3)), [7] * 40]
    frame = spark.createDataFrame([(v,) for v in values], "v array<int>")
    sums = frame.select(running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).collect()
    assert [(r.s, r.m) for r in sums] == [([sum(v[: k + 1]) for k in range(len(v))], [max(v[: k + 1]) for k in range(len(v))]) for v in values]
    ordered = [sorted(v) for v in values]
    found = spark.createDataFrame([(v, x) for v in ordered for x in range(-1, 305, 2)], "v array<int>, x int").select("v", "x", count_up_to(F.col("v"), F.col("x")).alias("n"))
    assert all(r.n == sum(e <= r.x for e in r.v) for r in found.collect())
