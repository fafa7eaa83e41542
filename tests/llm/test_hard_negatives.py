import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import hard_negatives
from pagemill.llm.hard_negatives import mine, threshold_join, whole_vectors


def brute_force(rows, anchors, positives=5, negatives=5):
    found = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        others = [(b, other, sum(p * q for p, q in zip(x, y))) for b, other, y in rows if b != a]
        best = sorted((-s, b) for b, other, s in others if other == label)[:positives]
        for minus, b in best:
            window = sorted((-s, c) for c, other, s in others if other != label and 80 * -minus <= 100 * s <= 100 * -minus)[:negatives]
            found += [(a, b, k + 1, c, -minus, -s) for k, (s, c) in enumerate(window)]
    return sorted(found)


def vectors(n=400, width=20):
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (12, width))
    rows = []
    for k in range(n):
        x = centres[int(rng.integers(12))] + rng.integers(-12, 12, width)
        rows.append((k, 0 if k % 3 == 0 else int(rng.integers(0, 5)), x.tolist()))
    copy = rows[30][2]
    rows += [(1000 + k, k % 2, copy) for k in range(90)]  # a group of equal vectors under two labels
    rows += [(2000, 8, [1] * width), (2001, 9, [0] * width), (2002, 9, [0] * width), (2003, 9, []), (2004, 9, [5] * (width + 7)), (2005, 9, [-200] * width)]
    return rows


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 37)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    anchors = {k for k, *_ in rows if k % 10 == 0 or k >= 2000}
    is_anchor = (F.col("vec_id") % 10 == 0) | (F.col("vec_id") >= 2000)
    want = brute_force(rows, anchors)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    for batch in (4096, 13):
        found = sorted(tuple(r[n] for n in names) for r in mine(frame, is_anchor, anchor_batch=batch).collect())
        assert found == want and len(want) > 200


def test_threshold_join_loses_no_pair():
    rng = np.random.default_rng(6)
    rows, anchors = rng.normal(0, 40, (300, 37)).round(), rng.normal(0, 40, (20, 37)).round()
    rows[:, 20:] /= 16
    rows = rows.round()
    every = anchors @ rows.T
    for share in (0.999, 0.9, 0.5, 0.0):
        least = np.quantile(every, share, axis=1)
        a, r, s = threshold_join(rows, anchors, least)
        assert set(zip(a.tolist(), r.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(every >= least[:, None])), strict=True))
        assert (s == every[a, r]).all()
    assert len(threshold_join(rows, anchors, np.full(20, -np.inf))[0]) == every.size
    assert len(threshold_join(rows[:0], anchors, np.zeros(20))[0]) == 0


def test_whole_vectors(spark):
    rows = [(1, [0.5, -0.001, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan")]), (6, [float("inf")]), (7, [-float("inf"), 0.0]), (8, [0.1])]
    for kind in ("float", "double"):
        found = {r.vec_id: r.v for r in spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").select("vec_id", whole_vectors(F.col("embedding")).alias("v")).collect()}
        assert found == {1: [128, -1, 256], 2: None, 3: [], 4: None, 5: None, 6: None, 7: None, 8: [25]}


def test_odd_rows_and_columns(spark):
    schema = "vec_id long, label long, vector array<long>, rank int, ids string, anchor_id map<string,int>"
    rows = [(0, 1, [10, 0]), (1, 1, [9, 0]), (2, 2, [8, 0]), (2, 2, [8, 0]), (3, None, [9, 0]), (None, 2, [9, 0]), (4, 2, None)]
    frame = spark.createDataFrame([(*row, 1, "x", {}) for row in rows], schema)
    found = [tuple(r) for r in mine(frame, F.col("vec_id") == 0).collect()]
    assert found == [(0, 1, 1, 2, 90, 80)]
    assert mine(frame.limit(0), F.lit(True)).count() == 0 and mine(frame, F.lit(False)).count() == 0
    assert mine(frame.filter("vec_id = 0"), F.lit(True)).count() == 0
    assert mine(frame.selectExpr("vec_id", "label", "array() AS vector").withColumn("vector", F.col("vector").cast("array<long>")), F.col("vec_id") == 0).count() == 2  # ids 2 and 4
