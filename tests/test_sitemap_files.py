"""Stored sitemaps: a file each, in few folders, written by many tasks."""

from workload import QUERIES, crawl


def test_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    rows = [(k, f"https://h{k % 3}.example/p/{k}", "<html></html>") for k in range(400)]
    spark.createDataFrame([*rows, rows[30]], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    seen, read = [], crawl.read_sitemaps

    def listing(spark, folder):
        for path, content in read(spark, folder).select("path", "content").collect():
            assert path.endswith(".gz") == (bytes(content[:2]) == b"\x1f\x8b")
            seen.append(path)
        return read(spark, folder)

    monkeypatch.setattr(crawl, "read_sitemaps", listing)
    found = {tuple(r) for r in QUERIES["sitemap_files"](spark, str(tmp_path)).collect()}
    folders = {path.rpartition("/")[0] for path in seen}
    assert len(seen) == 400 and 1 < len(folders) <= 4  # before: a folder per file, all written by one task
    assert ("site1", "https://site1.example/p/0", "page") in found and ("site3", "https://site3.example/common", "page") in found
    errors = {url for _, url, kind in found if kind == "ParseError"}
    # The page that comes twice is a file of two lines, which is no XML document.
    assert errors == {f"https://site{k % 4}.example/sm/{k // 4}.xml{'.gz' if k % 2 == 0 else ''}" for k in [30, *range(22, 400, 23)]}
