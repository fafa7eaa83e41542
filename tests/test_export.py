import json

from pagemill.operators import incremental as I
from pagemill.operators.pages import describe_pages
from pagemill.plans.site_export import export_sites, write_run
from pagemill.sources import documents as D
from pagemill.sources import manifest as M
from pagemill.streaming.changes import stream_change_status

RESPONSE = (
    "job_id string, page_id long, url string, html string, status_code int, headers map<string,string>, error_type string, error_message string"
)
ANSWER = "job_id string, url string, status_code int, content_type string, body_size long, error_type string, error_message string"
LONG = "enough words to be kept " * 8


def site(make_responses, changed=""):
    html = {"Content-Type": "text/html"}
    return make_responses(
        ("example.com", 1, "https://example.com", f'<title>Home</title><body><a href="/b">b</a><a href="/missing">m</a><a href="/f.pdf">f</a><a href="/down">d</a><p>home{changed}</p>', 200, html, None, None),
        ("example.com", 2, "https://example.com/b", f'<title>B</title><body><nav>menu</nav><main><h1>Bee</h1><p>{LONG}</p></main><a href="/f.pdf">f</a>', 200, html, None, None),
        ("example.com", 3, "https://example.com/missing", "<h1>404</h1>", 404, html, None, None),
        ("example.com", 4, "https://example.com/down", "", None, {}, "ConnectError", "refused"),
        schema=RESPONSE,
    )


def test_export_twice(spark, make_responses, make_jobs, tmp_path):
    jobs = spark.createDataFrame(
        [("example.com", "https://example.com", [], [], [], ["pdf"], 10, 3, "main", True, True, True)],
        "job_id string, start_url string, allowed_domains array<string>, include_patterns array<string>, exclude_patterns array<string>, "
        "attachment_extensions array<string>, max_pages int, max_depth int, content_extraction string, save_html boolean, save_markdown boolean, download_attachments boolean",
    )
    answers = spark.createDataFrame([("example.com", "https://example.com/f.pdf", 200, "application/pdf", 3, None, None)], ANSWER)
    nothing = M.read_manifest(spark, str(tmp_path / "absent.json"))
    assert nothing["pages"].count() == 0
    first = export_sites(site(make_responses), jobs, M.previous_pages(nothing["pages"]), answers)
    pages = {r["url"]: r for r in first.manifest["pages"].collect()}
    assert {u: (r["change_status"], r["success"], r["local_markdown_path"], r["depth"]) for u, r in pages.items()} == {
        "https://example.com": ("new", True, "pages/index.md", 0),
        "https://example.com/b": ("new", True, "pages/b.md", 1),
        "https://example.com/missing": ("new", False, None, 1),
    }
    assert pages["https://example.com/b"]["discovered_from"] == "https://example.com/"
    asset = first.manifest["assets"].collect()
    assert [(a["url"], a["local_path"], a["discovered_from"], a["file_size"]) for a in asset] == [
        ("https://example.com/f.pdf", "assets/f.pdf", "https://example.com/", 3)
    ]
    assert sorted((e["stage"], e["error_type"]) for e in first.manifest["errors"].collect()) == [
        ("page_crawl", "ConnectError"), ("page_response", "HttpStatusError"),
    ]
    summary = first.summary.first()
    assert (summary["pages"], summary["assets"], summary["errors"], summary["stop_reason"]) == (3, 1, 2, "queue_exhausted")

    assert {(r["kind"], r["rel_path"]) for r in first.writes.collect()} == {
        ("markdown", "pages/index.md"), ("markdown", "pages/b.md"), ("html", "html/index.html"), ("html", "html/b.html"),
    }
    write_run(first, str(tmp_path), "1")
    written = (tmp_path / "files/example.com/pages/b.md").read_text()
    assert written.startswith('---\ntitle: "Bee"\nurl: "https://example.com/b"\n') and "menu" not in written
    assert written.endswith(f"---\n\nBee\n===\n\n{LONG.strip()}\n")
    assert not (tmp_path / "files/example.com/pages/missing.md").exists()
    assert (tmp_path / "files/example.com/html/b.html").read_text() == site(make_responses).filter("page_id = 2").first()["html"]
    # The names of the files go to the texts: nothing of the pages' table is moved again.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = first.documents("markdown")._jdf.queryExecution().executedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(k for k, line in enumerate(plan) if "document" in line and "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [line for k, line in enumerate(plan[:scan]) if all(depth(other) > depth(line) for other in plan[k + 1 : scan + 1])]
    assert "Bucketed: true" in plan[scan] and any("Join" in line for line in above) and not any("Exchange" in line for line in above)

    # Both forms of the manifest serve as the previous run.
    tables = M.read_manifest_tables(spark, str(tmp_path / "manifest"), "1")
    nested = "".join(part.read_text() for part in sorted((tmp_path / "documents/run_id=1/job_id=example.com").glob("part-*")))
    (tmp_path / "manifest.json").write_text(json.dumps(json.loads(nested), indent=2))
    read = M.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert json.loads(nested)["source_url"] == "https://example.com" and read["errors"].count() == 2
    one, other = (sorted(map(tuple, M.previous_pages(p).drop("pos").collect())) for p in (tables["pages"], read["pages"]))
    assert one == other
    arrived = describe_pages(site(make_responses, "!"))
    status = {r["url"]: r["change_status"] for r in I.change_status(arrived, M.previous_pages(read["pages"])).collect()}
    assert status == {
        "https://example.com": "updated", "https://example.com/b": "unchanged", "https://example.com/missing": "unchanged",
        "https://example.com/down": "new",
    }
    again = export_sites(site(make_responses, "!"), jobs, M.previous_pages(read["pages"]), answers, existing=D.existing_files(spark, str(tmp_path / "files")).filter("rel_path != 'html/b.html'"))
    assert {(r["kind"], r["rel_path"]) for r in again.writes.collect()} == {("markdown", "pages/index.md"), ("html", "html/index.html"), ("html", "html/b.html")}


def test_last_previous_row_counts_and_paths_collide(spark):
    previous = spark.createDataFrame(
        [("j", "u", "old", 1), ("j", "u", "now", 2), ("j", "v", "x", 1)], "job_id string, normalized_url string, content_hash string, pos int"
    )
    pages = spark.createDataFrame(
        [("j", "u", "now", 1), ("j", "v", "y", 2), ("k", "u", "now", 3)], "job_id string, normalized_url string, content_hash string, page_id long"
    )
    status = {r["page_id"]: r["change_status"] for r in I.change_status(pages, previous).collect()}
    assert status == {1: "unchanged", 2: "updated", 3: "new"}
    docs = spark.createDataFrame([("j", "p", "a", 1), ("j", "p", "b", 2), ("j", "q", "c", 1)], "job_id string, rel_path string, text string, visit_order int")
    assert {(r["rel_path"], r["text"]) for r in D.resolve_paths(docs).collect()} == {("p", "b"), ("q", "c")}
    assert [r["rel_path"] for r in D.path_collisions(docs).collect()] == ["p"]


def test_stream_over_three_arrivals(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def arrive(n, *rows):
        spark.createDataFrame(list(rows), "page_id long, url string, html string").coalesce(1).write.parquet(str(source / f"b{n}"))
        stream = spark.readStream.schema("page_id long, url string, html string").option("recursiveFileLookup", True).parquet(str(source))
        query = (
            stream_change_status(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start(str(out))
        )
        query.awaitTermination()

    arrive(1, (1, "https://e.com/a", "x"), (2, "https://e.com/b/", "y"))
    arrive(2, (3, "https://E.com/a", "x"), (4, "https://e.com/b", "z"), (5, "https://e.com/c", ""))
    rows = {r["page_id"]: r["change_status"] for r in spark.read.parquet(str(out)).collect()}
    assert rows == {1: "new", 2: "new", 3: "unchanged", 4: "updated", 5: "new"}
