"""Hidden Markov language model trained by Baum-Welch over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import identified, stored
from pagemill.llm.hashing import word_hashes

STATES = 8
BUCKETS = 1 << 13
ROUNDS = 6
SEGMENT = 512
FREQUENT = 1 << 18
FOLDS, HELD_OUT = 7, 2
GROUP_TOKENS = 1 << 18
SEED = 20
SPLIT_BYTES = 1 << 21

END = np.uint64(0x656E64)  # the end of a text as a token
_PRIOR = 20.0


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and of each text how many: its words and one end."""
    words, counts = word_hashes(texts)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def _groups(batches: Iterator[pa.RecordBatch], size: int = GROUP_TOKENS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, tokens and token counts of some documents at a time, whole ones."""
    ids, parts, lengths = [], [], []
    for batch in batches:
        some, texts = (column.to_pylist() for column in batch.columns)
        ends = np.cumsum([len(text or b"") for text in texts])
        cuts = [0, *(np.flatnonzero(np.diff(ends // SPLIT_BYTES)) + 1).tolist(), len(texts)]  # long texts are split in few at a time
        for at, stop in zip(cuts, cuts[1:], strict=False):
            tokens, counts = _tokens([text or b"" for text in texts[at:stop]])
            ids += some[at:stop]
            parts.append(tokens)
            lengths.append(counts)
            if sum(map(len, parts)) >= size:
                yield ids, np.concatenate(parts), np.concatenate(lengths)
                ids, parts, lengths = [], [], []
    if ids:
        yield ids, np.concatenate(parts), np.concatenate(lengths)


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The end has the last bucket to itself."""
    return np.where(tokens == END, buckets, (tokens & np.uint64(buckets - 1)).astype(np.int64))


class Segments:
    """Sequences cut into segments: their starts, lengths, owners and numbers within the owner."""

    def __init__(self, lengths: np.ndarray, size: int = SEGMENT):
        count = np.maximum(1, -(-lengths // size))
        self.of = np.repeat(np.arange(len(lengths)), count)
        self.number = np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        self.starts = np.repeat(np.cumsum(lengths) - lengths, count) + self.number * size
        self.lengths = np.minimum(size, lengths[self.of] - self.number * size)
        self.alone = (count == 1)[self.of]

    def longest_first(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Order of the chosen segments by falling length, their starts, and at each step how many still have a token."""
        lengths = self.lengths[chosen]
        order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        return order, self.starts[chosen][order], active.tolist()

    def waves(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Places in ``chosen`` of all first segments, all second ones, and so on."""
        order = np.argsort(self.number[chosen], kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.number[chosen][order])) + 1)


@dataclass
class Model:
    """Start, transition and emission probabilities; emission is over buckets of words."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def log_likelihood(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence by the scaled forward recursion, its segments side by side."""
        parts = Segments(lengths)
        result = np.zeros(len(lengths))
        whole = parts.of[parts.alone]
        emit = np.ascontiguousarray(self.emit.T)
        result[whole] = self._scales(symbols, parts, np.flatnonzero(parts.alone), emit)
        long = np.flatnonzero(~parts.alone)
        if len(long):
            products, logs = self._products(symbols, parts, long, emit)
            state = np.tile(self.start, (len(lengths), 1))
            for part in parts.waves(long):
                owner = parts.of[long[part]]
                ahead = np.einsum("ni,nij->nj", state[owner], products[part])
                scale = ahead.sum(axis=1)
                state[owner] = ahead / scale[:, None]
                result[owner] += np.log10(scale) + logs[part]
        return result

    def _scales(self, symbols: np.ndarray, parts: Segments, chosen: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """log10 likelihood of sequences of one segment."""
        order, first, active = parts.longest_first(chosen)
        total, state = np.zeros(len(order)), np.tile(self.start, (len(order), 1))
        for step, n in enumerate(active):
            ahead = state[:n] if step == 0 else state[:n] @ self.move
            state = ahead * emit[symbols[first[:n] + step]]
            scale = state.sum(axis=1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        result = np.empty(len(order))
        result[order] = total
        return result

    def _products(self, symbols: np.ndarray, parts: Segments, chosen: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each chosen segment does to the states before it: a matrix scaled to a largest entry of one, and log10 of the scale.

        A first segment begins with its emission, a later one with a move.
        """
        states, move = len(self.start), self.move.astype(emit.dtype)
        order, first, active = parts.longest_first(chosen)
        result, logs = np.empty((len(order), states, states), emit.dtype), np.zeros(len(order))
        state = np.where((parts.number[chosen][order] == 0)[:, None, None], np.eye(states, dtype=emit.dtype), move)
        for step, n in enumerate(active):
            result[n : len(state)] = state[n:]
            ahead = state[:n] if step == 0 else (state[:n].reshape(-1, states) @ move).reshape(-1, states, states)
            state = ahead * emit[symbols[first[:n] + step]][:, None, :]
            if step % 8 == 7 or step == len(active) - 1:
                scale = state.max(axis=(1, 2))
                state /= scale[:, None, None]
                logs[:n] += np.log10(scale)
        result[: len(state)] = state
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return result[back], logs[back]

    def expected_counts(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch: expected starts, moves and emissions of some sequences.

        A long sequence is worked on in segments side by side. The products of
        its segments give the forward message that enters each of them and the
        backward message that leaves it, so nothing is lost at the borders.
        """
        states, parts = len(self.start), Segments(lengths)
        # Only the proportions between states count here: single precision holds them when the best state has 1.
        emit = np.ascontiguousarray((self.emit / self.emit.max(axis=0)).T.astype(np.float32))
        move, start = self.move.astype(np.float32), self.start.astype(np.float32)
        enter, leave = np.tile(start, (len(parts.lengths), 1)), np.ones((len(parts.lengths), states), np.float32)
        before = np.zeros((len(parts.lengths), states), np.float32)  # the forward message at the end of the segment before
        long = np.flatnonzero(~parts.alone)
        if len(long):
            products, _ = self._products(symbols, parts, long, emit)
            waves, state = parts.waves(long), np.tile(start, (len(lengths), 1))
            for part in waves:
                owner = parts.of[long[part]]
                if parts.number[long[part[0]]]:
                    before[long[part]] = state[owner]
                    enter[long[part]] = state[owner] @ move
                ahead = np.einsum("ni,nij->nj", state[owner], products[part])
                state[owner] = ahead / ahead.sum(axis=1, keepdims=True)
            for part in reversed(waves[1:]):
                after = np.einsum("nij,nj->ni", products[part], leave[long[part]])
                leave[long[part] - 1] = after / (before[long[part]] * after).sum(axis=1, keepdims=True)
        order, first, active = parts.longest_first(np.arange(len(parts.lengths)))
        kept, ahead = [], enter[order]
        for step, n in enumerate(active):
            if step:
                ahead = state[:n] @ move
            given = emit[symbols[first[:n] + step]]
            state = ahead * given
            scale = state.sum(axis=1, keepdims=True)
            state /= scale
            kept.append((state, given, scale))
        leaving = leave[order]
        moves, shares, back = np.zeros((states, states)), np.empty((len(symbols), states), np.float32), leaving[:0]
        for step in range(len(kept) - 1, -1, -1):
            state, given, scale = kept.pop()
            n = len(state)
            after = back if n == len(back) else np.concatenate([back, leaving[len(back) : n]])
            share = state * after
            shares[first[:n] + step] = share
            weighted = given * after
            weighted /= scale
            if step:
                moves += self.move * (kept[-1][0][:n].T @ weighted)
                back = weighted @ move.T
            else:
                opening = parts.number[order] == 0
                starts = share[opening].sum(axis=0, dtype=float)
                moves += self.move * (before[order][~opening].T @ weighted[~opening])
        shares /= shares.sum(axis=1, keepdims=True)
        emitted = np.stack([np.bincount(symbols, shares[:, k], self.emit.shape[1]) for k in range(states)])
        return starts, moves, emitted


def count_tokens(texts: DataFrame) -> DataFrame:
    """``token, c``: how often each token, known by its 64-bit hash, stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _groups(batches, 8 * GROUP_TOKENS):
            values, counts = np.unique(tokens, return_counts=True)
            for at in range(0, len(values), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[at : at + (1 << 16)].view(np.int64)), pa.array(counts[at : at + (1 << 16)])], ["token", "n"])

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("c"))


def coded_texts(texts: DataFrame, buckets: int) -> DataFrame:
    """``symbols``: the bucket of every token of a text, little-endian, for passes that come back to all texts."""
    kind = _symbol_kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, lengths in _groups(batches):
            codes, ends = bucket_of(tokens, buckets).astype(kind).tobytes(), np.cumsum(lengths) * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([pa.array([codes[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["symbols"])

    return stored(texts.mapInArrow(run, "symbols binary"))


def _symbol_kind(buckets: int) -> str:
    return "<u2" if buckets < 1 << 16 else "<u4"


def _coded_groups(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lengths of some documents at a time, whole ones."""
    parts, size = [], 0
    for batch in batches:
        for value in batch.column("symbols").to_pylist():
            parts.append(np.frombuffer(value, kind))
            size += len(parts[-1])
            if size >= 2 * GROUP_TOKENS:
                yield np.concatenate(parts).astype(np.int64), np.array([len(part) for part in parts])
                parts, size = [], 0
    if parts:
        yield np.concatenate(parts).astype(np.int64), np.array([len(part) for part in parts])


def baum_welch(coded: DataFrame, totals: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Train on all whole texts, as ``coded_texts`` gives them; expected counts are summed over the partitions each round.

    ``totals`` has how often each bucket occurs. The model (``states`` times
    buckets) is all that reaches the driver. States start from the bucket
    frequencies with fixed random factors and tend to stay.
    """
    size = len(totals)
    prior = (totals + 1) / (totals + 1).sum()
    emit = prior * np.exp(np.random.default_rng(SEED).normal(0, 1, (states, size)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))
    context, kind = coded.sparkSession.sparkContext, _symbol_kind(size - 1)
    for _ in range(rounds):
        shared = context.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(states + states**2 + states * size)
            for symbols, lengths in _coded_groups(batches, kind):
                total += np.concatenate([part.ravel() for part in shared.value.expected_counts(symbols, lengths)])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["i", "x"])

        summed = coded.select("symbols").mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros(states + states**2 + states * size)
        total[summed["i"].to_numpy()] = summed["x"].to_numpy()
        start, move, emit = total[:states] + 1, total[states : states + states**2].reshape(states, states) + 1e-3, total[states + states**2 :].reshape(states, size)
        emit = emit + _PRIOR * prior
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return model


class Lookup:
    """Places of hashes in a sorted table, by their first bits and then a step or two."""

    def __init__(self, table: np.ndarray):
        self.bits = np.uint64(64 - max(1, int(4 * len(table)).bit_length()))
        self.table = np.append(table, np.uint64(0))
        self.first = np.searchsorted(table, np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(table)))

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        slot = (found >> self.bits).astype(np.int64)
        place, end = self.first[slot], self.first[slot + 1]
        hit = (self.table[place] == found) & (place < end)
        open_ones = np.flatnonzero(~hit & (place + 1 < end))
        while len(open_ones):
            place[open_ones] += 1
            same = self.table[place[open_ones]] == found[open_ones]
            hit[open_ones] = same
            open_ones = open_ones[~same & (place[open_ones] + 1 < end[open_ones])]
        return place, hit


def score_documents(docs: DataFrame, held_out: Column | None = None, states: int = STATES, buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, train_types, base_score, score``.

    The model is trained on the documents that are not ``held_out`` (default:
    the fold of the id) and scores all. A state emits a bucket of words, the
    bucket a word with add-one frequency, so probabilities add up to one over
    the known words and one unknown word per bucket; ``score`` is the exact
    log10 probability of the whole text, ``base_score`` that of add-one word
    frequencies. Frequencies of the ``FREQUENT`` commonest tokens are
    broadcast; all others meet their frequency in a join. Training
    codes each text once and reads the codes in every round. A ``held_out`` of
    null counts as false.

    A null or empty text is its end alone. Rows without doc_id are left out, rows
    repeating one are one document, other columns are ignored, an empty table
    gives no rows; without training documents every token is unknown.
    """
    held_out = is_held_out(F.col("doc_id")) if held_out is None else held_out
    unique = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text", F.col("text").cast("binary"))
    training = unique.filter(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text")
    counts = stored(count_tokens(training))
    bucket = F.when(F.col("token") == int(END), buckets).otherwise(F.col("token").bitwiseAND(buckets - 1))
    in_bucket = counts.groupBy(bucket.cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).toArrow()
    totals, types = np.zeros(buckets + 1, np.int64), np.zeros(buckets + 1, np.int64)
    totals[in_bucket["b"].to_numpy()], types[in_bucket["b"].to_numpy()] = in_bucket["c"].to_numpy(), in_bucket["types"].to_numpy()
    top = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    order = np.argsort(tokens := top["token"].to_numpy().view(np.uint64))
    model = baum_welch(coded_texts(training, buckets), totals, states, rounds)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, np.log10(totals + types + 1.0), tokens[order], np.log10(top["c"].to_numpy()[order] + 1.0)))

    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("logs", pa.float64()), ("hits", pa.int64()), ("states", pa.float64()), ("rare", pa.list_(pa.int64()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_room, table, log_count = shared.value
        find = Lookup(table)
        for ids, found, lengths in _groups(batches, 4 * GROUP_TOKENS):
            symbols = bucket_of(found, len(log_room) - 1)
            place, hit = find(found)
            owner = np.repeat(np.arange(len(ids)), lengths)
            logs = np.zeros(len(found))
            logs[hit] = log_count[place[hit]]
            logs, hits = np.bincount(owner, logs, len(ids)), np.bincount(owner, hit, len(ids)).astype(np.int64)
            states = model.log_likelihood(symbols, lengths) - np.bincount(owner, log_room[symbols], len(ids))
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, lengths - hits)), pa.int32()), pa.array(found[~hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(logs), pa.array(hits), pa.array(states), rare], schema=fields)

    scored = stored(unique.mapInArrow(score, "doc_id long, n_tokens long, logs double, hits long, states double, rare array<long>"))
    rare = scored.select("doc_id", F.explode("rare").alias("token")).join(counts, "token")
    rare = rare.groupBy("doc_id").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"), F.count("*").alias("rare_hits"))
    train_tokens, train_types = int(totals.sum()), int(types.sum())
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return scored.join(rare, "doc_id", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("hits") + F.coalesce("rare_hits", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.lit(train_types).cast("long").alias("train_types"),
        (logs - F.col("n_tokens") * float(np.log10(train_tokens + train_types + 1.0))).alias("base_score"),
        (logs + F.col("states")).alias("score"),
    )
