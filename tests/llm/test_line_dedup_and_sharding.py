import duckdb
import pandas as pd
import pytest

from pagemill.llm.line_dedup import drop_repeated_chunks
from pagemill.llm.queries import ORACLES, QUERIES
from pagemill.llm.sharding import assign_shards, hash_bits, write_shards

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "a\nb\nc\nd\ne\nf\ng\nh"), (2, "x\na\nb\nc\nd\ne\nf\ng\nh"), (3, None), (4, ""), (5, "\n\n\n\n\n\n"), (6, "\n\n\n\n\n\n"),
    (7, "a\nb\nc\nd\ne\nf\ng\nh"), (8, "k\nl\n" * 3000), (9, "é\n日本\n" * 4), (10, "one line"), (11, "one line"),
]


@pytest.mark.parametrize("name", ["op1_line_dedup", "op9_sharding"])
@pytest.mark.parametrize("source", ["given", "odd"])
def test_query_equals_its_sql(spark, tmp_path, name, source):
    path = DATA
    if source == "odd":
        path = str(tmp_path)
        spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'s' AS shard", "1 AS place").write.parquet(f"{path}/documents.parquet")
    result = QUERIES[name](spark, path).toPandas()
    database = duckdb.connect()
    files = f"{path}/documents.parquet" if source == "given" else f"{path}/documents.parquet/*.parquet"
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    wanted = database.execute(ORACLES[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(result.columns) == columns
    a, b = (frame[columns].sort_values("doc_id").reset_index(drop=True).astype(str) for frame in (result, wanted))
    pd.testing.assert_frame_equal(a, b)


def test_shifted_passage_goes_and_the_first_stays(spark):
    rows = {r.doc_id: r for r in drop_repeated_chunks(spark.createDataFrame([*ODD, (None, "q"), (1, "later")], "doc_id long, text string")).collect()}
    assert set(rows) == {k for k, _ in ODD}
    assert rows[1].text == ODD[0][1] and rows[3].text is None and rows[4].text == "" and rows[5].text == rows[6].text == "\n" * 6
    assert rows[7]._n_removed_lines >= rows[2]._n_removed_lines > 0
    assert rows[10].text == rows[11].text == "one line"


def test_every_shard_fits(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (k % 90)) for k in range(600)] + [(600, "y" * 5000), (601, None), (None, "z"), (5, "again")], "doc_id long, text string")
    rows = assign_shards(docs, limit=1000).toPandas()
    assert sorted(rows["doc_id"]) == list(range(602))
    bits = {r.doc_id: f"{r.h:060b}" for r in docs.select("doc_id", hash_bits(docs.doc_id).alias("h")).distinct().collect() if r.doc_id is not None}
    assert all(bits[r.doc_id].startswith(r.shard) and len(r.shard) == r.shard_depth for r in rows.itertuples())
    for shard, group in rows.groupby("shard"):
        assert group["bytes"].sum() == group["shard_bytes"].iloc[0] and (group["bytes"].sum() <= 1000 or len(group) == 1)
        above = rows[rows["shard"].str.startswith(shard[:-1])]
        assert not shard or above["bytes"].sum() > 1000
    write_shards(docs, str(tmp_path / "out"), limit=1000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 602
    assert len(list((tmp_path / "out").glob("_shard=*/*.parquet"))) == rows["shard"].nunique()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_chunks(docs).count() == 0
    assert assign_shards(docs).count() == 0
