import re
from collections import Counter
from math import floor, log

import numpy as np

from pagemill.llm import lexical_search
from pagemill.llm.lexical_search import Queries, TermHashes, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute_force(docs, items, top):
    counts = {d: c for d, t in docs if (c := plain_counts(t))}
    n_docs, n_terms, df = len(counts), sum(c.total() for c in counts.values()), Counter(t for c in counts.values() for t in c)
    rows = []
    for item, text in items:
        scores = []
        for d, c in counts.items():
            m = 25 + (75 * c.total() * n_docs) // n_terms
            score = sum(n * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in plain_counts(text).items() if c[t])
            if score > 0:
                scores.append((-score, d))
        rows += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(rows)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(120)] + ["Größe", "naïve", "日本語", "ſtill", "don", "t", "İx"]
    texts = [" ".join(rng.choice(words, int(rng.lognormal(3, 1.2)) + 1, p=None)) for _ in range(250)]
    docs = list(enumerate(texts)) + [(1000 + k, texts[3] + " rare copy") for k in range(300)]  # a group of copies, all tied
    docs += [(2000, None), (2001, ""), (2002, " .,-\x7f"), (2003, "don't.W1,w1_W1|w2{w3}~\x00w4"), (2004, "w5 " * 5000 + "needle")]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(17)] + [(50, None), (51, "..."), (52, "unheard of"), (53, "RARE Copy copy copy"), (54, texts[7]), (55, "needle w5 w5")]
    return docs, items


def test_same_as_brute_force(spark):
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for top, batch in ((10, 512), (3, 5)):
        found = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in search(d, q, top, batch).collect())
        assert found == brute_force(docs, items, top)


def test_bounds_hold_with_many_false_bits(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(lexical_search, "BITS_PER_KEY", 1)
    blocks, hashes, rows = lexical_search._Blocks(), TermHashes(), []
    for d, text in docs:
        if counts := term_counts((text or "").encode()):
            rows += blocks.add(d, counts, hashes)
    rows += [blocks.close(width) for width in list(blocks.open)]
    assert sorted(d for row in rows for d in row["doc_ids"]) == [d for d, t in docs if plain_counts(t)]
    import pyarrow as pa

    terms = [(item, term.encode(), n, 7) for item, text in items for term, n in plain_counts(text).items()]
    queries = Queries(pa.table(dict(zip(("item_id", "term", "times", "w"), map(list, zip(*terms, strict=True)), strict=True))), 550, 20_000)
    texts, names, loose = dict(docs), list(queries.place), 0
    for row in rows:
        for item, bound in queries.upper_bounds(row["width"], np.array(row["lengths"]), row["slices"]):
            exact = np.array([queries.score(term_counts(texts[d].encode()), item, names) for d in row["doc_ids"]])
            assert (bound >= exact).all()
            loose += int((bound > exact).sum())
    assert loose


def test_long_texts_are_read_in_slices(monkeypatch):
    text = "Aé-bc\x00" * 500 + "日本" * 300 + " end"
    whole = {t.encode(): n for t, n in plain_counts(text).items()}
    for size in (1, 7, 100, 1 << 22):
        monkeypatch.setattr(lexical_search, "SLICE_BYTES", size)
        assert term_counts(text.encode()) == whole


def test_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, items int, score string, bound map<string,int>"
    docs = spark.createDataFrame([(1, "one two", 1, "s", {}), (1, "one two", 1, "s", {}), (None, "one", 1, "s", {}), (2, "two", None, None, None)], schema)
    items = spark.createDataFrame([(1, "ONE", 5), (1, "ONE", 5), (None, "two", 5), (2, "two", 5)], "item_id long, text string, doc_id int")
    found = sorted((r.item_id, r.rank, r.doc_id) for r in search(docs, items).collect())
    assert found == [(1, 1, 1), (2, 1, 2), (2, 2, 1)]
    assert search(docs.limit(0), items).count() == 0 == search(docs, items.limit(0)).count()
    assert search(docs.filter("doc_id = 2").selectExpr("doc_id", "'.' AS text"), items).count() == 0
