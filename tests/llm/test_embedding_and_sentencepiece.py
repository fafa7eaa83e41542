import numpy as np
import pytest
import sentencepiece

from pagemill.llm.embedding_dedup import audit_recall, near_duplicates, range_search, robust_prune
from pagemill.llm.sentencepiece_codec import MODEL, SPACE, best_states, decode, encode, pieces, times

ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n  x  \n y"), (5, "日本語 ﬁ é \x00 \U0001f600"), (6, "ing" * 400), (7, "the of   and  " * 60), (8, "a" * 999)]


def plain_links(rows):
    root, links = {k: k for k, _, _ in rows}, {k: 0 for k, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    def fine(label, vector):
        return label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector)

    able = [(k, label, np.array(vector, np.float32).astype(float)) for k, label, vector in rows if fine(label, vector)]
    for i, (a, la, x) in enumerate(able):
        for b, lb, y in able[i + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (links[k], find(k), find(k) == k) for k in links}


@pytest.mark.parametrize("small_label", [1500, 20])
def test_links_equal_brute_force(spark, monkeypatch, small_label):
    monkeypatch.setattr("pagemill.llm.embedding_dedup.SMALL_LABEL", small_label)  # 20: pivots, overlapping shards, blocks
    if small_label == 20:
        monkeypatch.setattr("pagemill.llm.embedding_dedup.PIVOT_ROWS", 40)
        monkeypatch.setattr("pagemill.llm.embedding_dedup.SHARD_ROWS", 64)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(120):
        base = rng.normal(size=16)
        for _ in range(1 + 39 * (k == 7) + int(rng.integers(0, 2))):
            rows.append((len(rows) + 10, k % 2, (base + rng.normal(size=16) * rng.choice([0, 0.02, 0.1])).tolist()))
    rows += [(900, 0, None), (901, 0, [0.0] * 16), (902, 0, [float("nan")] * 16), (903, 1, [None, *[1.0] * 15]), (904, None, rows[0][2]), (905, 1, [1.0]), (906, 1, [2.0]), (907, 1, [float("inf")] * 16), (908, 0, [])]
    table = spark.createDataFrame([*rows, (None, 0, rows[0][2]), rows[5]], "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS copies", "'k' AS key", "2 AS shard")
    result = near_duplicates(table)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result.collect()} == plain_links(rows)
    assert audit_recall(table, result, every=5) == 1.0


def test_a_dense_group_keeps_all_links(spark):
    """3,000 near copies under one label, with the parameters of production: the links of every vector."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=64)
    group = base + rng.normal(size=(3000, 64)) * np.linalg.norm(base) * 0.008
    others = rng.normal(size=(1500, 64))
    vectors = np.concatenate([group, others]).astype(np.float32)
    rows = [(k, 1, v) for k, v in enumerate(vectors.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    result = near_duplicates(table)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in result.collect()}
    assert (true[:3000] > 2500).all() and [found[k] for k in range(4500)] == true.tolist()
    assert audit_recall(table, result) == 1.0


def test_search_finds_what_is_in_range():
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=8) + rng.normal(size=(40, 8)) * 0.03])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    edges = robust_prune(vectors @ vectors.T)
    assert edges.shape[1] <= 16 and (edges != np.arange(340)[:, None]).all()
    found = sum(len(a) for a, _ in range_search(vectors, edges, np.arange(340), 0.98))
    assert found >= 0.9 * (vectors @ vectors.T >= 0.98).sum()


def test_no_vectors(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
LETTERS = ["a", "b", "e", " ", "  ", "\n", "the", "ing", "tion", "日", "é", "▁", "0", "  \n", "x", "J\u030c", "<s>", "\x00"]


def some_text(rng):
    return "".join(rng.choice(LETTERS[: int(rng.integers(1, len(LETTERS) + 1))], int(rng.integers(1, 300))))


def in_chunks(table, text, size):
    text = " " + text.replace(SPACE, " ")
    parts = [(text[k : k + size], text[max(0, k - table.longest) : k], text[k + size : k + size + table.longest]) for k in range(0, len(text), size)]
    matrices = [table.transfer(*part) for part in parts]
    states = best_states(matrices, 0, 0)
    ids = b"".join(table.trace(*part, i, j) for part, i, j in zip(parts, states, states[1:], strict=False))
    return matrices, sum(m[i, j] for m, i, j in zip(matrices, states, states[1:], strict=False)), np.frombuffer(ids, "<u4").tolist()


def test_ids_are_the_librarys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode(docs, giant_bytes=3000, chunk=700).collect()}
    assert {k: ids for k, ids in found.items() if ids != LIBRARY.encode(texts[k] or "")} == {}


def test_chunks_give_the_librarys_ids():
    table, rng = pieces(MODEL), np.random.default_rng(3)
    texts = [some_text(rng) for _ in range(150)] + ["a" * 2000, "日本" * 300, " " * 500, "tionab" * 200]
    for text in texts:
        ids = LIBRARY.encode(text)
        matrices, score, found = in_chunks(table, text, int(rng.integers(2 * table.longest, 120)))
        assert found == ids and abs(score - table.scores[ids].sum()) < 1e-6
        # The scan may combine neighbours in any order.
        left = right = None
        for matrix in matrices:
            left = matrix if left is None else times(left, matrix)
        for matrix in reversed(matrices):
            right = matrix if right is None else times(matrix, right)
        assert left.shape == (1, 1) and abs(left[0, 0] - score) < 1e-6 and abs(right[0, 0] - score) < 1e-6


@pytest.mark.parametrize("chunk", [32, 50])
def test_giant_texts_equal_whole_ones(spark, monkeypatch, chunk):
    monkeypatch.setattr("pagemill.llm.sentencepiece_codec.FAN_IN", 4)  # several levels
    docs = spark.createDataFrame([*ODD, (None, "gone"), (3, " ")], "doc_id long, text string").selectExpr("*", "1 AS k", "'m' AS m", "2 AS ids")
    table = pieces(MODEL)
    coded = encode(docs, giant_bytes=20, chunk=chunk)
    rows = {r.doc_id: r for r in coded.select("doc_id", "ids", "score", "n_chunks", decode(coded.ids).alias("text")).collect()}
    assert set(rows) == {k for k, _ in ODD}
    for k, text in ODD:
        ids = LIBRARY.encode(text or "")
        assert np.frombuffer(rows[k].ids, "<u4").tolist() == ids, k
        assert rows[k].text == (text or "") and abs(rows[k].score - table.scores[ids].sum()) < 1e-6
    assert rows[6].n_chunks > 8


def test_no_documents(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
