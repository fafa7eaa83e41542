import hashlib
import zlib

import numpy as np
from test_packing import whole_ids
from test_simhash_dedup import plain_components, plain_fingerprint
from test_suffix_dedup import plain as plain_repeats

import corpus_pipeline
from pagemill.llm.common import components, free_name, identified
from pagemill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "1 AS place", "'x' AS _cuts")
    docs = docs.union(docs.filter("doc_id < 3")).union(docs.limit(1).selectExpr("NULL", "text", "lang", "NULL", "n_chars", "place", "_cuts")).union(docs.limit(1).selectExpr("100000L", "NULL", "NULL", "source", "NULL", "place", "_cuts"))
    ids = {r.doc_id for r in docs.select("doc_id").collect()} - {None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, DATA)
        assert result.columns == docs.columns
        rows = result.collect()
        kept = [r.doc_id for r in rows]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        assert name in ("toxicity", "simhash_near_dedup") or set(kept) == ids
        assert all(r.n_chars == len(r.text) for r in rows if name.startswith(("line", "suffix")) and r.text is not None)
        docs, ids = spark.createDataFrame(rows, docs.schema), set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed["doc_id"]) == ids and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(7, 7), (300, 299), (299, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 100 for k in range(100, 161)} | {k: 1 for k in [1, *range(200, 260)]} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_line_dedup(texts):
    """Chunks cut at lines by their hashes; a chunk with two lines or more that stood before goes."""
    seen, result = set(), {}
    for doc_id in sorted(texts):
        if texts[doc_id] is None:
            result[doc_id] = None
            continue
        kept, chunk, before = [], [], 0
        lines = texts[doc_id].split("\n")
        for number, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            chunk.append(line)
            if (before * 1_000_003 + h) % 2_147_483_647 % 3 == 0 or number == len(lines) - 1:
                body = "\n".join(chunk)
                solid = sum(part != "" for part in chunk) >= 2
                if not (solid and body in seen):
                    kept += chunk
                if solid:
                    seen.add(body)
                chunk = []
            before = h
        result[doc_id] = "\n".join(kept)
    return result


def plain_chain(texts, toxic):
    """What each stage leaves, document by document."""
    stages = [{k: t for k, t in texts.items() if k not in toxic}]
    stages.append(plain_line_dedup(stages[-1]))
    ids = sorted(stages[-1])
    groups = plain_components(ids, [plain_fingerprint(stages[-1][k]) for k in ids])
    stages.append({k: stages[-1][k] for k in ids if groups[k] == k})
    cut = plain_repeats(list(stages[-1].items()), 100)
    stages.append({k: None if t is None else cut[k][0].decode(errors="ignore") for k, t in stages[-1].items()})
    return stages


def planted():
    rng = np.random.default_rng(17)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiouéñ" for c in ("n", "r", "sto", "lim")]

    def prose(lines, size=9):
        return "\n".join(" ".join(rng.choice(words, size)) for _ in range(lines))

    texts = {k: prose(int(rng.integers(3, 30))) for k in range(150)}
    toxic = set(range(1000, 1120))
    for k in toxic:
        parts = texts[k % 150].split() + ["vile", "hatemonger", "scumbag"] * 4
        rng.shuffle(parts)
        texts[k] = " ".join(parts)
    for k in range(8):
        texts[200 + k] = texts[k]  # exact copies
        texts[220 + k] = texts[10 + k].replace("a", "A")  # the same words for SimHash, other bytes
    block, passage = prose(12), prose(1, 40)
    for k in range(6):
        texts[300 + k] = f"{prose(4)}\n{block}\n{prose(5)}"  # lines that documents share
        texts[320 + k] = f"{prose(2)} {passage} é{prose(3)}"  # words that documents share within lines
    texts |= {400: None, 401: "", 402: " \n\t", 403: "lone", 404: "long " * 5000}
    return texts, toxic


def test_run_equals_a_plain_chain(spark, tmp_path, monkeypatch):
    texts, toxic = planted()
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), {"k": str(k)}) for k, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _chain map<string,string>"
    spark.createDataFrame([*rows, rows[0]], schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, int(k in toxic)) for k in texts if k % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    after, kept_as = [], corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda docs: after.append(kept_as(docs)) or after[-1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = plain_chain(texts, toxic)
    assert len(wanted[0]) == len(wanted[1]) == len(texts) - len(toxic) > len(wanted[2]) == len(wanted[3])
    assert all(any(a[k] != b.get(k) for k in a) for a, b in zip(wanted, wanted[1:], strict=False))  # each stage has something to do
    for (name, _), docs, expected in zip(corpus_pipeline.STAGES, after, wanted, strict=False):
        found = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" map<string,string>", "").split(", ")
        assert {k: r.text for k, r in found.items()} == expected, name
        assert all(r._chain == {"k": str(k)} and r.source == f"s{k % 3}" for k, r in found.items())
        if name != "toxicity":
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())
    pieces = {}
    for k, text in wanted[-1].items():
        ids = whole_ids(text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            pieces[k, piece] = at, len(part), zlib.crc32(part.tobytes())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == pieces
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        ends = np.cumsum([length for _, length in sorted(parts)])
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


INTERNAL = (
    "_chain", "_places", "_built", "_doc_id", "_n_lines", "_n_removed_lines", "_n_removed_chunks", "_cuts", "_cut", "_row", "_salt", "_rank", "_start", "_h", "_hot",
    "place", "lines", "key", "size", "first", "n", "body", "print", "root", "component_id", "fingerprint", "digit", "block", "spans", "kept", "piece", "length", "ids", "sequence_id", "offset", "toxic", "quality", "wanted",
)


def test_stages_keep_every_column(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 60")
    docs = docs.selectExpr("*", *[f"concat('{name}', doc_id) AS `{name}`" for name in INTERNAL], "map('a', doc_id) AS pairs", "doc_id AS `odd name`")
    docs = docs.union(docs.filter("doc_id < 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, DATA)
        assert result.columns == docs.columns, name
        for row in result.collect():
            assert all(row[column] == f"{column}{row.doc_id}" for column in INTERNAL) and row.pairs == {"a": row.doc_id} and row["odd name"] == row.doc_id
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == 60


def test_names_and_rows_that_repeat(spark):
    table = spark.createDataFrame([(1, {"b": 2}, "y"), (1, {"a": 9}, "z"), (1, None, "a"), (None, {"a": 1}, "q")], "doc_id long, m map<string,int>, _row string")
    assert free_name(table, "_ROW") == "__ROW" and free_name(table, "x") == "x"
    assert [tuple(r) for r in identified(table).collect()] == [(1, {"a": 9}, "z")]
