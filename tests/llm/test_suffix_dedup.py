import numpy as np
import pytest

from pagemill.llm.suffix_dedup import anchors, drop_repeats, remove_repeats


def plain(rows, window):
    seen, result = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            part = data[at : at + window]
            if part in seen:
                gone[at : at + window] = b"\1" * window
            seen.add(part)
        edges = np.diff(np.frombuffer(bytes(gone), np.uint8).astype(int), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        result[doc_id] = (bytes(c for c, g in zip(data, gone, strict=True) if not g), spans)
    return result


def test_equal_windows_share_their_digit():
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 101, 300, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, k, dtype=np.uint8)) + passage + b"tail" * k for k in (0, 7, 90)]
    digit, _, owner, start, count, lead = anchors(texts)
    found = [{} for _ in texts]
    for g, o, s, n, at in zip(digit, owner, start, count, lead, strict=True):
        for k in range(n):
            found[o][s + k] = (g, s + at - (s + k))
    for o, shift in enumerate((0, 7, 90)):
        assert [found[o][shift + k] for k in range(201)] == [found[0][k] for k in range(201)]
        assert sorted(found[o]) == list(range(len(texts[o]) - 99))


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefgh éñ\n"))
    make = lambda n: "".join(rng.choice(letters, n))
    passages = [make(int(n)) for n in (95, 130, 400)]
    rows = []
    for k in range(40):
        parts = [make(int(rng.integers(0, 150)))]
        for _ in range(int(rng.integers(0, 4))):
            passage = passages[int(rng.integers(0, 3))]
            cut = int(rng.integers(0, 30))
            parts += [passage[cut:], make(int(rng.integers(0, 60)))]
        rows.append((k, "".join(parts)))
    rows += [(40, None), (41, ""), (42, "x" * 99), (43, "x" * 1000), (44, "ab" * 300), (45, rows[0][1]), (46, rows[0][1])]
    docs = spark.createDataFrame([*rows, (None, rows[1][1]), (45, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 AS start", "'d' AS digit", "2 AS kept")
    wanted = plain(rows, 100)
    for r in remove_repeats(docs).collect():
        kept, spans = wanted.pop(r.doc_id)
        assert bytes(r.kept) == kept and [(s.start, s.stop) for s in r.spans] == spans and r.n_bytes == len((dict(rows)[r.doc_id] or "").encode())
    assert not wanted
    texts = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    assert texts[40] is None and texts[46] == "" and texts[0] == rows[0][1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0
