import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagemill.llm.packing import TOKENIZER, best_fit, best_values, configuration_program, pack_documents, packing_plan, sequences, token_pieces, word_ids

TEXTS = [
    "The quick brown FOX, jumped. over.. the lazy dog!!", "", None, " \n\t ", "éÉ Ünïcode ñandú ß ŸÿĲ 日本語 한국어 é ﬁ", "a<|endoftext|>b <|ENDOFTEXT|> don't we'll I'M",
    "x\x1cy z w\x85v", "…, a., .a '., 123.5, a1b2", "word " * 3000, "İstanbul ΣΑΣ µ ª º",
]


def whole_ids(text):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", TEXTS)
def test_word_ids_equal_the_tokenizer(text):
    ids = np.frombuffer(word_ids(TOKENIZER).encode((text or "").encode()), "<u4").tolist()
    assert [*ids, 0] == whole_ids(text)


def test_letters_and_marks_equal_the_tokenizer():
    marks = [chr(code) for code in range(0x300, 0x370)]
    text = " ".join(f"{letter}{mark} x{letter}{mark}y" for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for mark in marks)
    words, tokenizer = word_ids(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for word in text.split():
        assert np.frombuffer(words[word.encode()], "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, ascii(word)


def test_knapsack_equals_brute_force():
    prices = np.array([-np.inf, 1.0, -np.inf, 4.5, 5.0, -np.inf, -np.inf, -np.inf])
    best = [0.0]
    for room in range(1, 8):
        best.append(max([best[room - 1]] + [best[room - k] + prices[k] for k in range(1, room + 1)]))
    assert best_values(prices)[0].tolist() == best


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_all_pieces(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 101, [0, 5, 400, 20_000][seed]), minlength=101)
    plan = packing_plan(counts)
    held = np.zeros(101, np.int64)
    for parts, copies in plan.configurations:
        assert sum(length * many for length, many in parts) <= 100 and copies > 0
        for length, many in parts:
            held[length] += many * copies
    assert held.tolist() == counts.tolist()
    least = -(-int((counts * np.arange(101)).sum()) // 100)
    used = sum(copies for _, copies in plan.configurations)
    assert least <= plan.bound <= used == plan.sequences <= sum(copies for _, copies in best_fit(counts))
    program = configuration_program(counts, rounds=60)
    if counts.any():  # the prices are a solution of the dual, the weights one of the program
        assert best_values(program.prices)[0][100] <= 1 + 1e-9
        assert np.isclose(program.bound, (counts * np.where(counts > 0, program.prices, 0)).sum()) and program.bound <= sum(program.weights.values()) + 1e-6
        covered = np.zeros(101)
        for parts, weight in program.weights.items():
            assert sum(length * many for length, many in parts) <= 100 and weight > 0
            for length, many in parts:
                covered[length] += weight * many
        assert (covered >= counts - 1e-6).all()


@pytest.mark.parametrize("low, high", [(51, 100), (30, 60), (1, 100)])
def test_plan_beats_best_fit_or_equals_it(low, high):
    counts = np.bincount(np.random.default_rng(low).integers(low, high, 3000), minlength=101)
    plan, plain = packing_plan(counts), sum(copies for _, copies in best_fit(counts))
    assert plan.bound <= plan.sequences <= plain
    assert low > 50 and plan.bound == plan.sequences or plan.sequences <= 1.05 * plan.bound


def test_documents_are_packed_without_gaps(spark):
    rows = [(k, text) for k, text in enumerate(TEXTS * 3)] + [(None, "no id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' AS piece", "1 AS length", "2 AS _salt")
    placed = pack_documents(docs).collect()
    texts = {k: text for k, text in rows if k is not None}
    texts[3] = " \n\t "
    wanted = {}
    for k, text in texts.items():
        ids = whole_ids(text)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            wanted[k, piece] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in placed} == wanted
    inside = {}
    for r in placed:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(TEXTS)], "doc_id long, text string")
    pieces, placed = token_pieces(docs), pack_documents(docs)
    rows = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in sequences(pieces, placed).collect()}
    for r in placed.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == whole_ids(TEXTS[r.doc_id])[r.start : r.start + r.length]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
