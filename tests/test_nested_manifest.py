"""Nested manifests: documents of any size in parts, read back by byte ranges."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.sources import manifest as M
from pagemill.sources import nested_manifest as N

HARD = ['plain', 'a "quoted" } brace', 'back\\slash \\" [x', '{"pages": [{', 'ünï 日本 \U0001f600', '\\', '"', "}", "]},{", " ", "  line\nfeed\ttab"]


def page(k):
    return {
        "url": f"https://e.com/{k}", "normalized_url": f"https://e.com/{k}", "title": HARD[k % len(HARD)], "depth": k, "internal_links": HARD[: k % 5],
        "page_metadata": {"title": HARD[(k + 3) % len(HARD)], "authors": ["a}", "{b"]}, "success": k % 2 == 0, "content_hash": str(k),
    }


def document(pages, host="e.com"):
    return {
        "source_url": f"https://{host}", "crawl_started_at": "a }", "config_snapshot": {"deep": {"er": [{"x": "]}"}, {}]}, "list": [1, 2]},
        "other": [{"not": "a page"}, [{"nor": "this"}]], "pages": pages, "assets": [{"url": "https://e.com/f", "file_size": 3}], "errors": [],
    }


@pytest.fixture
def small_ranges(spark):
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":")}, {"indent": 1, "ensure_ascii": False}, {"indent": 2, "end": "\n\n"}])
def test_reads_a_document_by_byte_ranges(spark, tmp_path, small_ranges, layout):
    end = layout.pop("end", "")
    pages = [page(k) for k in range(40)]
    (tmp_path / "manifest.json").write_text(json.dumps(document(pages), **layout) + end, encoding="utf-8")
    assert N._fragments(spark, str(tmp_path / "manifest.json")).select("block").distinct().count() > 10
    tables = M.read_manifest(spark, str(tmp_path / "manifest.json"))
    found = tables["pages"].orderBy("pos").collect()
    assert [r.pos for r in found] == list(range(40)) and {r.job_id for r in found} == {"e.com"}
    for given, row in zip(pages, found, strict=True):
        assert (row.url, row.title, row.depth, row.internal_links, row.success, row.content_hash) == tuple(
            given[name] for name in ("url", "title", "depth", "internal_links", "success", "content_hash")
        )
        assert (row.page_metadata.title, row.page_metadata.authors, row.status_code) == (given["page_metadata"]["title"], ["a}", "{b"], None)
    assert [(r.url, r.file_size) for r in tables["assets"].collect()] == [("https://e.com/f", 3)] and tables["errors"].count() == 0
    run = tables["runs"].first()
    assert (run.job_id, run.crawl_started_at) == ("e.com", "a }") and json.loads(run.config_snapshot) == document([])["config_snapshot"]


def test_reads_several_documents(spark, tmp_path, small_ranges):
    for host, n in (("a.com", 3), ("b.com", 0), ("c.com", 9)):
        (tmp_path / host).mkdir()
        (tmp_path / host / "manifest.json").write_text(json.dumps(document([page(k) for k in range(n)], host)))
    tables = M.read_manifest(spark, str(tmp_path / "*" / "manifest.json"))
    assert {r.job_id: r["count"] for r in tables["pages"].groupBy("job_id").count().collect()} == {"a.com": 3, "c.com": 9}
    assert sorted(r.job_id for r in tables["runs"].collect()) == ["a.com", "b.com", "c.com"]


def empty(spark, name):
    return spark.createDataFrame([], f"job_id string, {M.TABLES[name]}")


def million(spark, n):
    columns = {c.name: F.lit(None).cast(c.dataType) for c in M._fields("pages")}
    url = F.concat(F.lit("https://e.com/p/"), F.col("id"))
    columns |= {"url": url, "normalized_url": url, "title": F.concat(F.lit('t} "'), F.col("id")), "content_hash": F.sha2(F.col("id").cast("string"), 256)}
    job = F.when(F.col("id") % 50 == 0, "small.com").otherwise("e.com").alias("job_id")
    return spark.range(n).select(job, F.col("id").alias("visit_order"), *[c.alias(name) for name, c in columns.items()])


def runs(spark):
    fields = {c.name: F.lit(None).cast(c.dataType) for c in M._fields("runs")}
    fields["source_url"] = F.concat(F.lit("https://"), F.col("job_id"))
    return spark.createDataFrame([("e.com",), ("small.com",), ("none.com",)], "job_id string").select("job_id", *[c.alias(name) for name, c in fields.items()])


def test_a_million_pages_round_trip(spark, tmp_path):
    pages = million(spark, 1_000_000)
    errors = spark.createDataFrame([("e.com", "https://e.com/p/1", "page_response", "X", "same")] * 2, f"job_id string, {M.ERROR_FIELDS}")
    M.write_nested_manifests({"runs": runs(spark), "pages": pages, "assets": empty(spark, "assets"), "errors": errors}, str(tmp_path / "out"))
    small = "".join(part.read_text() for part in sorted((Path(tmp_path) / "out" / "job_id=small.com").glob("part-*")))
    loaded = json.loads(small)
    assert [p["url"] for p in loaded["pages"]] == [f"https://e.com/p/{k}" for k in range(0, 1_000_000, 50)] and loaded["assets"] == []
    assert json.loads((next((tmp_path / "out" / "job_id=none.com").glob("part-*"))).read_text())["pages"] == []
    parts = sorted((tmp_path / "out" / "job_id=e.com").glob("part-*"))
    assert len(parts) > 1  # no task had the whole document
    tables = M.read_manifest(spark, str(tmp_path / "out"))
    back = tables["pages"].select("job_id", "url", "title", "content_hash", "pos")
    place = F.when(F.col("job_id") == "small.com", F.col("visit_order") / 50).otherwise(F.col("visit_order") - F.floor(F.col("visit_order") / 50) - 1).cast("int")
    given = pages.select("job_id", "url", "title", "content_hash", place.alias("pos"))
    total = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()
    assert total(back) == total(given)
    assert [(r.job_id, r.message) for r in tables["errors"].collect()] == [("e.com", "same")] * 2
