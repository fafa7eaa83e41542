"""Change status in order of arrival, and counters per batch."""

from pyspark.sql import functions as F

from pagemill.streaming.progress import ProgressLog, observed
from pagemill.streaming.versions import VersionLog

PAGE = "page_id long, url string, html string, arrived int"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), PAGE)


def test_versions_arrive_in_order_and_batches_may_repeat(spark, tmp_path):
    seen = {}

    def write(statuses, batch_id):
        seen[batch_id] = [(r.page_id, r.change_status) for r in statuses.orderBy("arrived", "page_id").collect()]

    log = VersionLog(spark, str(tmp_path / "one"), buckets=3)
    run = log.process(write, ["arrived"])
    first = batch(spark, (1, "https://e.com/a", "x", 3), (2, "https://E.com/a/", "y", 1), (3, "https://e.com/a", "x", 2), (4, "https://e.com/b", "", 1), (5, "https://e.com/c", None, 1))
    run(first, 0)
    assert seen[0] == [(2, "new"), (4, "new"), (5, "new"), (3, "updated"), (1, "unchanged")]
    second = batch(spark, (6, "https://e.com/a", "x", 1), (7, "https://e.com/b", "z", 1), (8, "https://e.com/b", "z", 1))
    for _ in range(2):  # tried again after its rows were already kept
        run(second, 1)
        assert seen[1] == [(6, "unchanged"), (7, "updated"), (8, "unchanged")]
    run(second.limit(0), 2)
    assert seen[2] == []
    assert log.table.read().filter("batch_id = 1").select("normalized_url").distinct().count() == 1  # only what changed is kept

    # A later session goes on from the path, and so does a compacted log.
    again, smaller = VersionLog(spark, str(tmp_path / "one"), buckets=3), log.compact(str(tmp_path / "two"))
    third = batch(spark, (9, "https://e.com/b", "", 1), (10, "https://e.com/d", "q", 1), (11, "https://e.com/a", "x", 9))
    for table in (again, smaller):
        table.process(write, ["arrived"])(third, 3)
        assert seen[3] == [(9, "updated"), (10, "new"), (11, "unchanged")]


def test_only_the_batch_is_moved(spark, tmp_path):
    from pagemill.streaming.versions import last_hashes, versions

    log = VersionLog(spark, str(tmp_path / "log"), buckets=4)
    arrived = batch(spark, (1, "https://e.com/a", "x", 3)).withColumn("job_id", F.concat(F.lit("j"), "page_id"))
    plan = versions(arrived, log.table.read(), 1, ["arrived"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    assert last_hashes(log.table.read(), 5).count() == 0


def test_counters_of_batches(spark, tmp_path):
    schema = "page_id long, url string, html string, status_code int, error_type string"
    log = ProgressLog(keep=2)
    spark.streams.addListener(log)
    try:
        for number, rows in enumerate(([(1, "u", "abc", 200, None), (2, "v", "d", 404, None)], [(3, "w", None, 200, "Timeout")], [(4, "w", "ef", None, None)])):
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"in/{number}"))
            stream = observed(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
            query = stream.select("page_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(log)
    rows = [tuple(r) for r in log.rows(spark).orderBy("batch_id").collect()]
    assert rows == [(1, 1, 0, 1, 0, 3), (2, 1, 0, 0, 2, 4)]  # the first has gone: two are kept
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*")).first()[0] == 4
