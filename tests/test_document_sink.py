"""The file sink: all documents of a write appear, or none."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pagemill.sources import documents as D
from pagemill.sources.document_sink import document_path, list_files, read_files, write_files

DOCUMENT = "job_id string, rel_path string, text string, visit_order long"


def tree(folder):
    return {str(path.relative_to(folder)): path.read_text() for path in folder.rglob("*") if path.is_file()}


def test_documents_replace_older_ones(spark, tmp_path):
    first = [("a.com", f"pages/p/{k}.md", f"text {k} é", k) for k in range(30)] + [("b.com:81", "html/index.html", None, 1)]
    D.write_document_files(spark.createDataFrame(first, DOCUMENT).repartition(5), str(tmp_path / "out"))
    want = {f"a.com/pages/p/{k}.md": f"text {k} é" for k in range(30)} | {"b.com:81/html/index.html": ""}
    assert tree(tmp_path / "out") == want
    again = [("a.com", "pages/p/1.md", "early", 1), ("a.com", "pages/p/1.md", "late", 5), ("a.com", "pages/p/1.md", "later", 5)]
    D.write_document_files(spark.createDataFrame(again, DOCUMENT), f"file:{tmp_path}/out")
    assert tree(tmp_path / "out") == want | {"a.com/pages/p/1.md": "later"}
    D.write_document_files(spark.createDataFrame([], DOCUMENT), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want | {"a.com/pages/p/1.md": "later"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    old = spark.createDataFrame([("a.com", "pages/0.md", "old", 1)], DOCUMENT)
    D.write_document_files(old, str(tmp_path / "out"))

    @F.udf("string")
    def text(k):
        if k == 77:
            raise RuntimeError("lost")
        return f"new {k}"

    rows = spark.range(0, 80, 1, 8).select(F.lit("a.com").alias("job_id"), F.concat(F.lit("pages/"), F.col("id"), F.lit(".md")).alias("rel_path"), text("id").alias("text"))
    with pytest.raises(Exception, match="lost"):
        write_files(rows, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"a.com/pages/0.md": "old"}
    write_files(rows.filter("rel_path != 'pages/77.md'"), str(tmp_path / "out"))
    assert len(tree(tmp_path / "out")) == 79 and tree(tmp_path / "out")["a.com/pages/0.md"] == "new 0"


def test_paths_stay_below_their_job():
    assert document_path("a.com", "pages/./x//y.md") == "a.com/pages/x/y.md" and document_path("a/b", "x") == "a%2Fb/x"
    for path in ("../x", "/etc/x", "pages/../../x", "."):
        with pytest.raises(ValueError):
            document_path("a.com", path)


def test_only_shared_texts_are_moved(spark):
    rows = spark.createDataFrame([("j", f"p{k % 9}", f"t{k}", k) for k in range(10)], DOCUMENT)
    found = {r.rel_path: (r.text, r.n_pages) for r in D.resolve_paths(rows).collect()}
    assert found == {f"p{k}": (f"t{k}", 1) for k in range(1, 9)} | {"p0": ("t9", 2)}
    plan = D.resolve_paths(rows)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "LeftAnti" in plan.split("Union")[1].split("BroadcastExchange")[0]  # the one aggregate of shared paths


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    rows = [("a.com:81", f"pages/d{k % 3}/e/{k}.md", f"text {k} é", k) for k in range(40)] + [("b/c", "html/_metadata x/1.html", "page", 1), ("b/c", "html/é %20 b.html.gz", "x" * 50, 1)]
    hidden = [("b/c", f"html/{name}", "no", 1) for name in ("_x/1.html", ".y", "_z", "1._COPYING_")] + [("b/c", "html/empty.html", None, 1), ("b/c", "html/_k=1", "partition", 1)]
    D.write_document_files(spark.createDataFrame(rows + hidden, DOCUMENT).repartition(3), root := str(tmp_path / "out %41"))
    listed = list_files(spark, root)
    assert "binaryFile" not in listed._jdf.queryExecution().toString()  # whose files the driver lists
    usual = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    want = sorted((row["path"].removeprefix("file:"), bytes(row["content"])) for row in usual.select("path", "content").collect())
    assert sorted((row["path"], bytes(row["content"])) for row in read_files(listed, root).collect()) == want and len(want) == 43
    found = {tuple(row) for row in D.existing_files(spark, f"file:{root}").collect()}
    assert found == {(r[0], r[1]) for r in rows} | {("b/c", "html/_k=1")}
    assert sorted(map(tuple, D.existing_files(spark, f"{tmp_path}/out*").collect())) == sorted(found)


def test_empty_and_missing_folders(spark, tmp_path):
    D.write_document_files(spark.createDataFrame([], DOCUMENT), str(tmp_path / "out"))
    assert D.existing_files(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        D.existing_files(spark, str(tmp_path / "absent"))
