import re
import struct
from collections import Counter, defaultdict
from math import ceil, floor

import numpy as np
import xxhash

from pagemill.llm import mixing
from pagemill.llm.mixing import mix, mixed_documents

ODD = [(900, None, "x"), (901, "", "x"), (902, " \n\t ", None), (903, "lone word", None), (904, "very long " * 30_000, "y"), (905, "", "empty")]


def hashed(*parts):
    seed = 42
    for part in parts:
        raw = part.encode() if isinstance(part, str) else struct.pack("<i" if part < 1000 and part not in IDS else "<q", part)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


IDS: set[int] = set()


def draw(*parts):
    return (hashed(mixing.SEED, *parts) >> 11) * 2.0**-53


def settle(a, b, chance):
    """Move words from b to a or back; both are [doc_id, size, mass]."""
    gain, loss = min(a[1] - a[2], b[2]), min(a[2], b[1] - b[2])
    moved = gain if chance * (gain + loss) < loss else -loss
    return a[2] + moved, b[2] - moved


def whole(size, mass):
    return 1 if mass >= size * (1 - 1e-9) else 0 if mass <= size * 1e-9 else None


def plain_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and rest > 1e-6:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def plain_mix(docs, fan_in, heavy):
    """The same pairing in plain Python, document by document."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for d, text, _ in docs}
    sizes = defaultdict(int)
    for d, _, source in docs:
        sizes[source] += size[d]
    target, taken = plain_targets(sizes, (3, 1, 2), 1.5, 2), {}
    for source in sizes:
        members = [d for d, _, s in docs if s == source]
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        base = floor(rate + 1e-9)
        part = max(rate - base, 0.0)
        part = part if part > 1e-9 else 0.0
        up = Counter()
        due = sorted((d for d in members if part and size[d]), key=lambda d: (-size[d], d))
        total, mass, layer = float(sizes[source]), sizes[source] * part, []
        for d in (d for d in due if size[d] * heavy > sizes[source]):
            own = min(mass / total, 1.0) * size[d]
            pool = ["", max(total - size[d], 0.0), 0.0]
            pool[2] = min(max(mass - own, 0.0), pool[1])
            own, left = settle([d, size[d], own], pool, draw(d))
            total, mass = pool[1], min(max(left, 0.0), pool[1])
            if whole(size[d], own) is None:
                layer.append((d, size[d], own, 1))
            else:
                up[d] = whole(size[d], own)
        light = [d for d in due if size[d] * heavy <= sizes[source]]
        chance = part if not up and not layer else mass / total if total else 0.0
        layer += [(d, size[d], chance * size[d], len(light)) for d in light]
        level = 0
        while max((n for *_, n in layer), default=0) > 1 or (level == 0 and len(layer) > 1):
            groups = defaultdict(list)
            for d, n_words, m, n in layer:
                many = ceil(n / fan_in)
                h = hashed(level, d)
                groups[(h - (1 << 64) if h >> 63 else h) % many].append((-n_words, d, m, many))
            layer = []
            for group in groups.values():
                open_one = None
                for minus, d, m, many in sorted(group):
                    if open_one is None:
                        open_one = [d, -minus, m]
                        continue
                    first, second = settle(open_one, [d, -minus, m], draw(open_one[0], d))
                    a, b = whole(open_one[1], first), whole(-minus, second)
                    up.update({x: v for x, v in ((open_one[0], a), (d, b)) if v is not None})
                    open_one = [open_one[0], open_one[1], first] if a is None else [d, -minus, second] if b is None else None
                if open_one:
                    layer.append((*open_one, many))
            level += 1
        for d, n_words, m, _ in layer:
            up[d] = int(draw(d, "last") * n_words < m)
        taken |= {d: (base + up[d]) * size[d] for d in members}
    return size, dict(sizes), target, taken


def corpus(n=600):
    rng = np.random.default_rng(5)
    sources = ["a", "é", "Z", "\U0001f600", "￿", None]
    docs = [(1000 + k, "w " * int(rng.lognormal(3, 1)), "hot" if k % 3 == 0 else sources[int(rng.integers(6))]) for k in range(n)]
    return docs + [(5000, "big " * 4000, "a")] + ODD


def test_same_as_plain_pairing(spark):
    docs = corpus()
    IDS.update(d for d, *_ in docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for fan_in, heavy in ((mixing.FAN_IN, mixing.HEAVY), (4, 16)):
        size, sizes, target, taken = plain_mix(docs, fan_in, heavy)
        rows = {r.doc_id: r for r in mix(frame, fan_in=fan_in, heavy=heavy).collect()}
        assert set(rows) == set(size)
        for d, _, source in docs:
            assert (rows[d].size, rows[d].source_size) == (size[d], sizes[source])
            assert abs(rows[d].target - target[source]) < 1e-6 * (1 + target[source])
            assert rows[d].taken == taken[d] <= 2 * size[d], d


def test_sources_come_near_their_targets(spark):
    docs = [d for d in corpus(3000) if d[0] != 904]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mix(frame.repartition(7)).collect()
    by_source, due = Counter(), {}
    source_of = {d: s for d, _, s in docs}
    for r in rows:
        by_source[source_of[r.doc_id]] += r.taken
        due[source_of[r.doc_id]] = r.target
    assert all(abs(by_source[s] - due[s]) <= 0.01 * due[s] + 2 for s in due)
    assert abs(sum(due.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    again = {r.doc_id: r.taken for r in mix(frame.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_odd_rows_and_columns(spark):
    schema = "doc_id long, text string, source string, size int, key string, k int, copies string, _copies map<string,int>, taken int"
    extra = (7, "k", 1, "c", {"a": 1}, 3)
    docs = [(d, t, s, *extra) for d, t, s in ODD] + [(None, "no id", "x", *extra), (903, "lone word", None, *extra), (903, "another", "zz", *extra)]
    frame = spark.createDataFrame(docs, schema)
    rows = mix(frame).collect()
    assert sorted(r.doc_id for r in rows) == [900, 901, 902, 903, 904, 905]
    assert all(r.taken == 0 for r in rows if r.size == 0)
    mixed = mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == {r.doc_id: r.copies for r in rows if r.copies}
    assert mix(frame.limit(0)).count() == 0 and mixed_documents(frame.limit(0)).count() == 0
    assert mix(frame.filter("text = ''")).filter("taken = 0").count() == 2
