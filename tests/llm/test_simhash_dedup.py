import numpy as np
import pytest
import xxhash

from pagemill.llm.simhash_dedup import codewords, drop_near_duplicates, fingerprint, fuzzy_keys, golay_tables, linked, simhash_groups


def plain_fingerprint(text, shingle_words=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, max_bits=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, p in zip(ids, prints, strict=True):
        for y, q in zip(ids, prints, strict=True):
            if x < y and bin(p ^ q).count("1") <= max_bits:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_equals_its_definition():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = " ".join(rng.choice(["The", "the", "of", "Añb", "x.", "É", "日本"], n))
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_code_is_perfect():
    _, errors = golay_tables()
    assert len(set(errors.tolist())) == 2048
    every = np.arange(1 << 23)
    assert np.bincount(codewords(every)).tolist() == [2048] * 4096


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for distance in range(5):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in base], dtype=np.uint64)
        rows, keys = fuzzy_keys(base)
        others, other_keys = fuzzy_keys(base ^ flips)
        for i in range(len(base)):
            assert set(keys[rows == i]) & set(other_keys[others == i])


def test_dense_group_is_joined_with_few_links(spark):
    centre = 0x0123456789ABCDEF
    prints = [centre] + [centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40) if a != b]
    prints = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    links = linked(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    joined = plain_components(range(len(prints)), [0] * len(prints), -1)
    assert set(joined.values()) == set(range(len(prints)))
    assert len(links) < 40 * len(prints)
    reached, at = {links[0].a}, None
    while at != len(reached):
        at = len(reached)
        for link in links:
            if link.a in reached or link.b in reached:
                reached |= {link.a, link.b}
    assert reached == set(prints)


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choice(words, 120).tolist()
        for k in range(int(rng.integers(1, 4))):
            copy = list(base)
            copy[int(rng.integers(0, 120))] = f"n{k}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (None, "gone"), rows[5], (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS print", "1 AS key", "2 AS root")
    result = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()}
    wanted = {i: t for i, t in reversed(rows) if i is not None}
    wanted[7] = rows[7][1]
    prints = {i: plain_fingerprint(t) for i, t in wanted.items()}
    groups = plain_components(sorted(prints), [prints[i] for i in sorted(prints)])
    assert result == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}
    kept = drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))
    assert set(kept[0].asDict()) == {"doc_id", "text", "print", "key", "root"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0
