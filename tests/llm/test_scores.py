import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from pagemill.llm.hashing import run_hashes, word_hashes
from pagemill.llm.language_model import Model, score_documents
from pagemill.llm.quality_rules import judge, log_ratios
from pagemill.llm.toxicity import classify, drop_toxic

ODD = [(1, "one Two\ttwo\n\x0bthree"), (2, None), (3, ""), (4, " \n"), (5, "A É é a\x1cb"), (6, "w " * 5000), (7, "b c " * 40)]


def test_word_hashes_follow_words():
    texts = [text.encode() for _, text in ODD if text is not None]
    hashes, counts = word_hashes(texts)
    words = [w for text in texts for w in text.lower().split()]
    assert counts.tolist() == [len(text.split()) for text in texts]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    runs, counts = run_hashes([b"the&&& a", b"", b"&&&"])
    assert counts.tolist() == [3, 0, 1] and runs[1] == runs[3]


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, mark = Counter(windows), [False] * len(words)
    for k, window in enumerate(windows):
        if often[window] > 1:
            mark[k : k + 8] = [True] * 8
    failed = len(words) < 20 or 100 * sum(mark) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, sum(mark), failed


def test_quality_rules(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["tree", "house", "river", "stone", "and", "the"], 60)) + f" u{k}" for k in range(60)]
    junk = [" ".join(w + "&&&" for w in text.split()) for text in clean[:10]]
    rows = [*((k, text) for k, text in enumerate(clean + junk, 100)), *ODD, (8, "same line\nsame line\n\nx#$%"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS llr", "'k' AS kept")
    labels = spark.createDataFrame([*((k, 1) for k in range(100, 150)), (160, 0), (160, 1), (None, 1), (150, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert set(found) == {k for k, _ in rows if k is not None}
    for k, text in rows[:-1]:
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(text), k
        assert not (r.base_failed and r.kept)
    assert all(found[k].kept for k in range(100, 160)) and not any(found[k].kept for k in range(160, 170))
    assert judge(docs.limit(0), labels).count() == 0
    assert {r.llr for r in judge(docs, labels.limit(0)).collect()} == {0.0}


def test_log_ratios_are_of_two_multinomials():
    ratios = log_ratios(np.array([3, 0]), np.array([4, 4]))
    assert np.allclose(ratios, [math.log(4 / 5 / (5 / 10)), math.log(1 / 5 / (5 / 10))])


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(4)
    raw = rng.random((3, 3)), rng.random((3, 5)), rng.random(3)
    model = Model(raw[2] / raw[2].sum(), raw[0] / raw[0].sum(1, keepdims=True), raw[1] / raw[1].sum(1, keepdims=True))
    parts = [np.array([0, 4, 2, 2]), np.array([1]), np.array([3, 3, 0])]
    symbols, lengths = np.concatenate(parts), np.array([4, 1, 3])
    starts, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), []
    for part in parts:
        paths = list(itertools.product(range(3), repeat=len(part)))
        chance = np.array([model.start[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod(model.emit[list(p), part]) for p in paths])
        logs.append(math.log10(chance.sum()))
        for path, share in zip(paths, chance / chance.sum(), strict=True):
            starts[path[0]] += share
            for a, b in itertools.pairwise(path):
                moves[a, b] += share
            for state, symbol in zip(path, part, strict=True):
                emits[state, symbol] += share
    assert np.allclose(model.log_likelihood(symbols, lengths), logs)
    for got, wanted in zip(model.expected_counts(symbols, lengths), (starts, moves, emits), strict=True):
        assert np.allclose(got, wanted)


def test_language_model(spark):
    rng = np.random.default_rng(2)
    topics = [[f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]]
    rows = [(k, " ".join(rng.choice(topics[k % 2], int(rng.integers(1, 400))))) for k in range(100, 260)] + ODD
    docs = spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS token", "2 AS c")
    found = {r.doc_id: r for r in score_documents(docs, rounds=4, states=4).collect()}
    tokens = {k: [*(text or "").encode().lower().split(), None] for k, text in rows}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(t for k, ts in tokens.items() if not out[k] for t in ts)
    total, types = sum(counts.values()), len(counts)
    for k, ts in tokens.items():
        r = found.pop(k)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[k], len(ts), sum(counts[t] > 0 for t in ts), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in ts), rel_tol=1e-9)
        assert r.score < 0
        tokens[k] = (r.score, r.base_score)
    assert not found
    held = [tokens[k] for k in tokens if out[k] and k >= 100]
    assert sum(s for s, _ in held) > sum(b for _, b in held)
    assert score_documents(docs.limit(0)).count() == 0


def test_toxicity_on_unseen_documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text, toxic = rng.choice(words, int(rng.integers(5, 80))).tolist(), k % 5 == 0
        for _ in range(3 * toxic):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(["vile", "Nasty,", f"hatemonger{rng.integers(0, 99)}"])))
        rows.append((k, " ".join(text)))
        if k < 400:
            labels.append((k, int(rng.random() < 0.8), int(toxic)))
    extra = [(1000, None), (1001, ""), (1002, "vile " * 20_000), (None, "vile")]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string").selectExpr("*", "0.5 AS toxic", "1 AS features")
    table = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (399, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r._chain.toxic >= 0.5 for r in classify(docs, table).collect()}
    wrong = [k for k in range(400, 600) if found[k] != (k % 5 == 0)]
    assert len(wrong) <= 4 and len(found) == 603
    assert not found[1000] and not found[1001]
    kept = drop_toxic(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, bad in found.items() if not bad}
    assert classify(docs.limit(0), table).count() == 0
    assert drop_toxic(docs, table.limit(0)).count() == 603


def plain_baum_welch(model, symbols):
    """log10 likelihood and expected starts, moves and emissions of one sequence, a step at a time."""
    forward, scales = [], []
    for step, symbol in enumerate(symbols):
        state = (forward[-1] @ model.move if step else model.start) * model.emit[:, symbol]
        scales.append(state.sum())
        forward.append(state / scales[-1])
    moves, emitted, after = np.zeros_like(model.move), np.zeros_like(model.emit), np.ones(len(model.start))
    for step in range(len(symbols) - 1, -1, -1):
        share = forward[step] * after
        emitted[:, symbols[step]] += share
        weighted = model.emit[:, symbols[step]] * after / scales[step]
        if step:
            moves += model.move * np.outer(forward[step - 1], weighted)
            after = model.move @ weighted
    return np.log10(scales).sum(), share, moves, emitted


def test_segments_lose_nothing():
    rng = np.random.default_rng(9)
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape))
    model = Model(part(4), part(4, 4), part(4, 11))
    lengths = np.array([1, 7, 511, 512, 513, 2000, 2, 1024, 1025])
    symbols = rng.integers(0, 11, lengths.sum())
    one_by_one = [plain_baum_welch(model, part) for part in np.split(symbols, np.cumsum(lengths)[:-1])]
    np.testing.assert_allclose(model.log_likelihood(symbols, lengths), [found[0] for found in one_by_one])
    for got, want in zip(model.expected_counts(symbols, lengths), zip(*[found[1:] for found in one_by_one], strict=True), strict=True):
        np.testing.assert_allclose(got, sum(want), rtol=1e-4)  # single precision
