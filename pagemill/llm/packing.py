"""Best-fit packing of tokenised documents by a configuration linear program."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm.common import identified, stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHED_WORDS = 600_000
RANK_SALTS = 64

ROUNDS = 400
GAP = 0.001
STEP = 0.25
MOST_LACK = 1 / 16
LEARNING_RATE = 0.5
PRICE_POWER = 1.1


class WordIds(dict):
    """Little-endian ids of each word (a run without ASCII white space), encoded when first met.

    White space separates the tokenizer's units, so the ids of a text are those
    of its words one after another.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.units = self.tokenizer.model.tokenize
        printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [byte for byte in range(256) if byte not in printable]
        self.alphabet = {byte: chr(byte) for byte in printable} | {byte: chr(256 + k) for k, byte in enumerate(hidden)}

    def __missing__(self, word: bytes) -> bytes:
        if word.isascii() and b"<|" not in word and word != (lower := word.lower()):  # others only after normalisation
            value = self[word] = self[lower]
            return value
        if word.isalpha():  # ASCII letters are one unit as they are
            ids = [unit.id for unit in self.units(word.lower().decode())]
        elif word[-1:] in (b".", b",") and word[:-1].isalpha():
            value = self[word] = self[word[:-1]] + self[word[-1:]]
            return value
        else:
            text = word.decode()
            if text.isalpha() and max(text) <= "\xff":  # letters that normalisation leaves alone
                ids = [unit.id for unit in self.units("".join(map(self.alphabet.__getitem__, text.lower().encode())))]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = self[word] = np.array(ids, "<u4").tobytes()
        return value

    def encode(self, text: bytes) -> bytes:
        ids = b"".join(map(self.__getitem__, text.split()))
        if len(self) > CACHED_WORDS:
            self.clear()
        return ids


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian 32-bit) of every whole text and its end id.

    Only a document longer than ``capacity`` is cut; its last piece may be
    shorter. ``tokenizer`` is a file that every executor can open.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer).encode
        for batch in batches:
            ids, pieces, starts, lengths, values = [], [], [], [], []
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                tokens = encode(text or b"") + end
                for at in range(0, len(tokens), 4 * capacity):
                    part = tokens[at : at + 4 * capacity]
                    ids.append(doc_id)
                    pieces.append(at // (4 * capacity))
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    values.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


Configuration = tuple[tuple[int, int], ...]  # (length, how many), the longest first


def best_values(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity.

    ``prices[l]`` is the worth of one piece of length l, -inf where there is
    none. Returns the best worth within each capacity and the length to take
    there (0: leave one place empty).
    """
    capacity = len(prices) - 1
    value, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upward = prices[1:]
    for room in range(1, capacity + 1):
        worth = value[room - 1 :: -1] if room else value[:0]
        total = worth + upward[:room]
        at = int(total.argmax())
        if total[at] >= value[room - 1]:
            value[room], take[room] = total[at], at + 1
        else:
            value[room] = value[room - 1]
    return value, take


def _columns(take: np.ndarray, lengths: np.ndarray, capacity: int) -> list[Configuration]:
    """For each length the best configuration that holds it, from the knapsack's choices."""
    choice, found = take.tolist(), []
    least = next((room for room, length in enumerate(choice) if length), capacity + 1)
    for length in lengths.tolist():
        parts, room = {length: 1}, capacity - length
        while room >= least:
            if size := choice[room]:
                parts[size] = parts.get(size, 0) + 1
                room -= size
            else:
                room -= 1
        found.append(tuple(sorted(parts.items(), reverse=True)))
    return found


@dataclass
class Program:
    """A solution of the configuration program: weights of configurations, prices of the lengths, and the bound they prove."""

    weights: dict[Configuration, float]
    prices: np.ndarray
    bound: float


def configuration_program(counts: np.ndarray, rounds: int = ROUNDS, gap: float = GAP) -> Program:
    """Solve the configuration program of a length histogram by multiplicative weights.

    The program: the least total weight of configurations (lengths that fit into
    one sequence together) that covers the ``counts[l]`` pieces of each length.
    Each round prices the lengths, and a knapsack finds the best configuration
    that holds each length; from the longest on, every length takes as much of
    its own as the ones before have left uncovered. A length that the round covers
    too often gets cheaper by a factor, one whose best configuration is worth less
    than the best of all dearer, in steps that shrink. Prices over the knapsack's
    best worth solve the dual, so each round bounds the sequences from below;
    every round's weights cover everything, so they bound the program from above.
    Rounds end when the two are within ``gap``.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    prices = np.full(capacity + 1, -np.inf)
    if not len(lengths):
        return Program({}, prices, 0.0)
    need, place = counts[lengths].astype(float), np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    bound, proven, best, cheapest = float(need @ lengths) / capacity, lengths / capacity, {}, np.inf
    price = (lengths / capacity) ** PRICE_POWER
    for number in range(rounds):
        prices[lengths] = price
        value, take = best_values(prices)
        price, worth = price / value[capacity], (price + value[capacity - lengths]) / value[capacity]
        if (shown := float(need @ price)) > bound:
            bound, proven = shown, price
        taken, given = _cover(_columns(take, lengths[::-1], capacity), lengths[::-1].tolist(), need.tolist(), place.tolist())
        if (total := sum(taken.values())) < cheapest:
            cheapest, best = total, taken
        if cheapest <= (1 + gap) * bound:
            break
        step = LEARNING_RATE / (1 + number / 8)
        price = price * np.exp(step * (np.clip(1 - given / need, -1, 1) + np.minimum((1 - worth) / price, 1)))
    prices[lengths] = proven
    return Program(best, prices, bound)


def _cover(configurations: Iterable[Configuration], owners: list[int], need: list[float], place: list[int]) -> tuple[dict[Configuration, float], np.ndarray]:
    """Take of each length's own configuration what is still uncovered of it; returns the weights and the coverage."""
    left, weights = list(need), {}
    for config, owner in zip(configurations, owners, strict=True):
        open_part = left[place[owner]]
        if open_part <= 0:
            continue
        amount = open_part / next(many for size, many in config if size == owner)
        weights[config] = weights.get(config, 0.0) + amount
        for size, many in config:
            left[place[size]] -= amount * many
    return weights, np.array(need) - np.array(left)


def rounded(program: Program, counts: np.ndarray) -> tuple[list[tuple[Configuration, int]], np.ndarray]:
    """Whole copies of configurations that the program's prices allow, as far as there are pieces; and the counts left over.

    A configuration belongs to a best solution only if its pieces are worth a
    whole sequence. The best one for each length is taken by whole copies, a
    quarter of what the scarcest of its lengths allows, then again for the
    lengths that still have pieces; the worth it may lack grows when few are found.
    """
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    prices = program.prices * (1 + 1e-7 * np.arange(capacity + 1) / capacity)  # of equal ways the one with longer pieces
    chosen: Counter[Configuration] = Counter()
    lack = 0.0
    while (left > 0).any() and lack <= MOST_LACK:
        there = np.flatnonzero(left)
        value, take = best_values(np.where(left > 0, prices, -np.inf))
        near = there[prices[there] + value[capacity - there] >= 1 - lack - 1e-9][::-1]
        pool, pending, moved = left.tolist(), int(left.sum()), 0
        for config in _columns(take, near, capacity):
            if most := min(pool[size] // many for size, many in config):
                copies = max(1, int(most * STEP))
                for size, many in config:
                    pool[size] -= many * copies
                chosen[config] += copies
                moved += copies * sum(many for _, many in config)
        left = np.array(pool, np.int64)
        if 500 * moved < pending:
            lack = max(1 / 1024, 2 * lack)
    return list(chosen.items()), left


def best_fit(counts: np.ndarray) -> list[tuple[Configuration, int]]:
    """Best-fit decreasing over a histogram; equal sequences are kept as one entry with a count."""
    capacity = len(counts) - 1
    by_gap: dict[int, dict[Configuration, int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = next((g for g in range(length, capacity) if by_gap.get(g)), None)
            if gap is None:
                many = capacity // length
                for held, copies in ((many, left // many), (left % many, 1)):
                    if held and copies:
                        slots = by_gap[capacity - held * length]
                        slots[((length, held),)] = slots.get(((length, held),), 0) + copies
                left = 0
            else:
                old, copies = by_gap[gap].popitem()
                used = min(copies, left)
                if copies > used:
                    by_gap[gap][old] = copies - used
                parts = Counter(dict(old))
                parts[length] += 1
                new = tuple(sorted(parts.items(), reverse=True))
                slots = by_gap[gap - length]
                slots[new] = slots.get(new, 0) + used
                left -= used
    return [(parts, copies) for slots in by_gap.values() for parts, copies in slots.items()]


@dataclass
class Plan:
    """Configurations with their copies, how many sequences they make, and the least that any packing needs."""

    configurations: list[tuple[Configuration, int]]
    sequences: int
    bound: int


def packing_plan(counts: np.ndarray) -> Plan:
    """Hold exactly the histogram's pieces: the rounded program or plain best fit, whichever needs fewer sequences."""
    program = configuration_program(counts)
    chosen, left = rounded(program, counts)
    options = [chosen + best_fit(left), best_fit(counts)]
    made = [sum(copies for _, copies in option) for option in options]
    least = made.index(min(made))
    return Plan(options[least], made[least], ceil(program.bound - 1e-6))


def _slots(plan: list[tuple[Configuration, int]], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted by length and rank."""
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for parts, copies in plan:
        offset = 0
        for length, many in parts:
            rows.append((length, used[length], base, copies, offset))
            used[length] += copies * many
            offset += length * many
        base += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to a stored table of pieces ``doc_id, piece, length``.

    Only the length histogram (``capacity`` rows) reaches the driver. Pieces of a
    length are ranked in salted slices, so a length that a third of all pieces
    share still fills many tasks; the rank says the place in the plan. The plan
    has at most as many rows as rounds and lengths allow, whatever the input.
    """
    lengths = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        counts[row["length"]] = row["count"]
    slots = _slots(packing_plan(counts).configurations, capacity)
    plan = pieces.sparkSession.sparkContext.broadcast((slots[:, 0] << 40 | slots[:, 1], slots))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_SALTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_start") + F.col("_rank")).alias("_rank"))

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = plan.value
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "_rank"))
            row = table[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth % row[:, 3], row[:, 4] + nth // row[:, 3] * length
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a
    row per piece. A null or empty text is its end id alone. Rows without doc_id
    are left out, rows repeating one are one document, other columns are
    ignored, an empty table gives no rows. The ids themselves are in
    ``token_pieces``; ``sequences`` joins them.
    """
    pieces = token_pieces(identified(docs.select("doc_id", "text")), tokenizer, capacity, end_id)
    return pack(stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed ids, at most ``capacity`` in a row."""
    parts = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(inside, lambda p: p["ids"]), "")).alias("ids"))
