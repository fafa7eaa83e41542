"""Streams over tables stored as one file and as a folder of files."""

import glob
import os

import pytest

from pagemill.session import ensure_checkpoint_dir
from workload import QUERIES

PAGE = "<html><head><title> T{0} </title></head><body><nav><ul><li><a href=\"/p/{0}\">x</a></li><li><a href=\"/q\">y</a></li></ul></nav></body></html>"


@pytest.fixture(params=["file", "folder"])
def tables(request, spark, tmp_path):
    rows = [(k, f"https://h{k % 3}.example/p/{k}", PAGE.format(k)) for k in range(1, 13)]
    written = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    if request.param == "folder":
        written.write.parquet(str(tmp_path / "t" / "pages.parquet"))
    else:
        written.coalesce(1).write.parquet(str(tmp_path / "parts"))
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "pages.parquet").write_bytes(next((tmp_path / "parts").glob("part-*")).read_bytes())
    spark.range(1).write.parquet(str(tmp_path / "t" / "other.parquet"))
    return str(tmp_path / "t")


def test_change_status_of_every_page(spark, tables):
    rows = QUERIES["stream_change_status"](spark, tables).collect()
    assert {tuple(r) for r in rows} == {(k, 1 - k % 2, 1, 0) for k in range(1, 13)} and len(rows) == 12


def test_links_of_every_page(spark, tables):
    rows = QUERIES["stream_links"](spark, tables).collect()
    assert {r["page_id"]: (r["n_links"], r["title"]) for r in rows} == {k: (2, f"T{k}") for k in range(1, 13)}


def test_decisions_and_metadata_reach_the_result(spark, tmp_path):
    page = '<html lang="en"><head><title>T{0}</title></head><body><nav><ul><li><a href="/a">x</a></li><li><a href="/a">y</a></li><li><a href="/blocked/1">z</a></li></ul></nav><h1>Head {0}</h1></body></html>'
    spark.createDataFrame([(k, f"https://h.example/p/{k}", page.format(k)) for k in (1, 2)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = QUERIES["stream_links"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(k, 3, f"T{k}", 1, 2, f"Head {k}", "en") for k in (1, 2)]
    stored = spark.read.parquet(max(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/*/metadata"), key=os.path.getmtime))
    assert {(r["page_metadata"]["title"], r["page_metadata"]["url"]) for r in stored.collect()} == {(f"Head {k}", f"https://h.example/p/{k}") for k in (1, 2)}
    assert {"page_metadata_raw", "content_hash", "raw_title"} <= set(stored.columns)
