"""SimHash near-duplicates found with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, identified, stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# (lowest bit, width) of the three segments of a fingerprint; a segment is zero-extended to 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero for a text without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = len(words) - shingle_words + 1
    if count <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle_words - 1 :].tolist(), strict=True)], "<u8"
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 255):  # so that a byte holds each sum
        octets = hashes[at : at + 255].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit message, and the error pattern of each 11-bit syndrome.

    The binary [23, 12, 7] code is perfect: each syndrome belongs to one error of
    at most three bits, so every 23-bit word has one codeword within three bits.
    """
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= generator << (bit - 11)
        return word

    parity = np.array([remainder(message << 11) for message in range(4096)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << bit for bit in bits)
            errors[remainder(pattern)] = pattern
    return parity, errors


def codewords(words: np.ndarray) -> np.ndarray:
    """Index (the 12-bit message) of the codeword nearest to each 23-bit word."""
    parity, errors = golay_tables()
    return (words ^ errors[parity[words >> 11] ^ (words & 2047)]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: for each pair of segments the codeword pairs within one bit flip.

    Two fingerprints that differ in at most four bits differ in at most two bits
    over some two of the three segments. One flip on either side then meets
    halfway, so they share a key. A key is (pair, codeword, codeword).
    """
    prints = prints.astype(np.uint64)
    segments = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    own = [codewords(segment) for segment in segments]
    near = [
        codewords(segment[:, None] ^ (1 << np.arange(width))[None, :]) for segment, (_, width) in zip(segments, SEGMENTS, strict=True)
    ]
    rows, keys = [], []
    for family, (i, j) in enumerate(combinations(range(3), 2)):
        pairs = np.concatenate(
            [(own[i] << 12 | own[j])[:, None], near[i] << 12 | own[j][:, None], own[i][:, None] << 12 | near[j]], axis=1
        )
        pairs.sort(axis=1)
        fresh = np.ones(pairs.shape, bool)
        fresh[:, 1:] = pairs[:, 1:] != pairs[:, :-1]
        row, _ = np.nonzero(fresh)
        rows.append(row)
        keys.append(family << 24 | pairs[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, print`` (signed 64 bits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            values = np.fromiter((fingerprint(t or b"", shingle_words) for t in texts.to_pylist()), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(values.view(np.int64))], ["doc_id", "print"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, print long")


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                rows, keys = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(run, "key int, print long")


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints within ``max_bits`` (4 at most) of one another.

    First each key's fingerprints are held against its smallest one; that joins
    dense groups with a link per fingerprint and key. Then the fingerprints of a
    key are paired only where these links have not joined them yet, so a group
    of many close fingerprints never gives all its pairs. Every link is checked
    bit by bit, and every pair within the distance ends up connected.
    """
    if max_bits > 4:
        raise ValueError("three segments guarantee a common key up to four bits")
    keys = stored(_keys(prints))
    least = keys.groupBy("key").agg(F.min("print").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("first"))) <= max_bits
    stars = stored(
        keys.join(least, "key").filter(near & (F.col("print") != F.col("first"))).select(F.col("print").alias("a"), F.col("first").alias("b")).distinct()
    )
    roots = components(stars).withColumnsRenamed({"node": "print"})
    rooted = keys.join(roots, "print", "left").select("key", "print", F.coalesce("root", "print").alias("root"))
    x, y = rooted.alias("x"), rooted.alias("y")
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.print") < F.col("y.print"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= max_bits),
    )
    return stars.union(pairs.select(F.col("x.print").alias("a"), F.col("y.print").alias("b")).distinct())


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, print, fingerprint, component_id`` of every document.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest doc_id reachable. Equal fingerprints are one
    node, so a third of all rows with one text cost one node. A null or empty
    text has fingerprint zero and is linked like any other. Rows without doc_id
    are left out, rows repeating a doc_id are one document (``identified``),
    other columns are ignored, an empty table gives no rows.
    """
    prints = stored(fingerprints(identified(docs.select("doc_id", "text")), shingle_words))
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(linked(nodes, max_bits)).withColumnRenamed("node", "print")
    classes = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", "print", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without all but the smallest doc_id of each group, all columns kept."""
    unique = identified(docs)
    groups = simhash_groups(unique, shingle_words, max_bits)
    kept = groups.filter("doc_id = component_id").select("doc_id")
    return unique.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{name}`") for name in docs.columns])
