"""SentencePiece encoding and decoding; giant documents by a parallel scan in the max-plus semiring."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from pagemill.llm.common import identified, stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")
GIANT_BYTES = 1 << 16
CHUNK = 1 << 14
FAN_IN = 64
CACHED_UNITS = 500_000
CACHED_PAIRS = 500_000

SPACE = "▁"
_NEVER = -np.inf
_UNIT = re.compile("\n| *[^ \n]+| +")

State = tuple[int, int]  # characters before a boundary and behind it


class Pieces(dict):
    """A byte-pair model with byte fallback, and the ids of each unit met so far.

    Every boundary between units is a token boundary: no piece holds a line
    feed, or a space mark after another character (checked when loading). Merges
    never reach over units, so the ids of a text are those of its units.

    A sequence of pieces is the model's encoding of their text if and only if
    each neighbouring two are, of theirs: merges that kept every two of them
    apart never join across a border. So the encoding of a long text is the one
    path of pieces in which all neighbours fit, and whether pieces at the ends
    of a chunk lie on it is seen from the chunk alone.
    """

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            raw = file.read()
        model.ParseFromString(raw)
        if model.trainer_spec.model_type != model.trainer_spec.BPE or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model without normalisation is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.number = {p.piece.replace(SPACE, " "): k for k, p in enumerate(model.pieces) if p.type in (p.NORMAL, p.USER_DEFINED)}
        if any("\n" in piece or " " in piece.lstrip(" ") for piece in self.number):
            raise ValueError("pieces may not reach over units")
        self.byte = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.byte_ids = frozenset(self.byte.values())
        self.scores = np.array([p.score for p in model.pieces])
        self.text = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for byte, k in self.byte.items():
            self.text[k] = bytes([byte])
        self.longest = max(map(len, self.number))
        self.opening = self.library.encode("\n")  # the dummy prefix and a line feed
        self.pairs: dict[tuple[str, str], bool] = {}

    def raw(self, text: str) -> list[int]:
        """The ids of a part of a text, without a dummy prefix."""
        return self.library.encode("\n" + text)[len(self.opening) :] if text else []

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = np.array(self.raw(unit), "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text or a part of one, cut where units begin or pieces end."""
        found = b"".join(map(self.__getitem__, _UNIT.findall(text)))
        if len(self) > CACHED_UNITS:
            self.clear()
        return found

    def score(self, ids: bytes) -> float:
        return float(self.scores[np.frombuffer(ids, "<u4")].sum())

    def decode(self, ids: bytes) -> bytes:
        """The text of some ids, the dummy prefix's space included."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def own(self, piece: str) -> list[int]:
        """The ids of a piece, or the bytes of a character that is none."""
        known = self.number.get(piece)
        return [known] if known is not None else [self.byte[byte] for byte in piece.encode()]

    def fit(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when encoded together."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.raw(left + right) == self.own(left) + self.own(right)
        return known

    def _end_piece(self, text: str, ids: list[int], place: int) -> str:
        """The first (0) or last (-1) piece of some ids, as text."""
        return text[place] if ids[place] in self.byte_ids else self.text[ids[place]].decode()

    def states(self, before: str, behind: str) -> list[State]:
        """The pieces that may end at a boundary or lie across it, from up to ``longest`` characters on each side."""
        found = []
        for left in range(1, min(len(before), self.longest) + 1):
            for right in range(min(len(behind), self.longest - left) + 1):
                piece = before[len(before) - left :] + behind[:right]
                if (piece in self.number or (left == 1 and not right)) and self.raw(piece) == self.own(piece):
                    found.append((left, right))
        return found

    def transfer(self, text: str, before: str, ahead: str) -> np.ndarray:
        """Max-plus matrix of a chunk: score of the path from each entry to each exit state, never where there is none.

        A state is the piece at a boundary of chunks, as the ``states`` on its two
        sides; the start and the end of a text are one state each. ``before``
        and ``ahead`` are the characters around the chunk that such a piece may
        reach. A path counts the pieces that begin in the chunk. Where the chunk
        has boundaries of units, entries and exits meet there.
        """
        size = len(text)
        entries = self.states(before, text[: self.longest]) if before else [(0, 0)]
        exits = self.states(text[-self.longest :], ahead) if ahead else [(0, 0)]
        matrix = np.full((len(entries), len(exits)), _NEVER)
        cuts = [m.start() for m in _UNIT.finditer(text) if m.start() >= self.longest and self._certain(text, m.start())]
        cuts = [cut for cut in cuts if not ahead or cut <= size - self.longest]

        def way(begin: int, stop: int) -> tuple[float, str, str]:
            ids = self.raw(text[begin:stop])
            if not ids:
                return 0.0, "", ""
            return float(self.scores[ids].sum()), self._end_piece(text[begin:stop], ids, 0), self._end_piece(text[begin:stop], ids, -1)

        def entered(state: State) -> str:
            return before[len(before) - state[0] :] + text[: state[1]] if state[0] else ""

        def left(state: State) -> str:
            return text[size - state[0] :] + ahead[: state[1]] if state[0] else ""

        def goes(first: str, second: str) -> bool:
            return not first or not second or self.fit(first, second)

        if cuts:
            first, last = cuts[0], cuts[-1]
            heads = {right: way(right, first) for right in {state[1] for state in entries}}
            tails = {many: way(last, size - many) for many in {state[0] for state in exits}}
            head = np.array([heads[s[1]][0] if goes(entered(s), heads[s[1]][1]) else _NEVER for s in entries])
            tail = np.array([tails[s[0]][0] + self._alone(left(s)) if goes(tails[s[0]][2], left(s)) else _NEVER for s in exits])
            return head[:, None] + self.score(self.encode(text[first:last])) + tail[None, :]
        ways: dict[tuple[int, int], tuple[float, str, str]] = {}
        for i, entry in enumerate(entries):
            for j, leave in enumerate(exits):
                begin, stop = entry[1], size - leave[0]
                if begin > stop:
                    continue
                if (begin, stop) not in ways:
                    ways[begin, stop] = way(begin, stop)
                score, opens, closes = ways[begin, stop]
                fits = goes(entered(entry), opens) and goes(closes, left(leave)) if opens else goes(entered(entry), left(leave))
                if fits:
                    matrix[i, j] = score + self._alone(left(leave))
        return matrix

    def _alone(self, piece: str) -> float:
        return float(self.scores[self.own(piece)].sum()) if piece else 0.0

    def trace(self, text: str, before: str, ahead: str, entry: int, leave: int) -> bytes:
        """The ids that begin in a chunk, between its entry and its exit state."""
        begin, stop, last = 0, len(text), ""
        if before:
            begin = self.states(before, text[: self.longest])[entry][1]
        if ahead:
            left, right = self.states(text[-self.longest :], ahead)[leave]
            stop, last = len(text) - left, text[len(text) - left :] + ahead[:right]
        return self.encode(text[begin:stop]) + np.array(self.own(last) if last else [], "<u4").tobytes()

    @staticmethod
    def _certain(text: str, place: int) -> bool:
        """Whether a unit that starts here does so whatever stands before the chunk."""
        return text[place] == "\n" or text[place - 1] == "\n" or (text[place] == " " and text[place - 1] != " ")


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def best_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries of a best path through some matrices, from ``entry`` to ``leave``."""
    ahead = [matrices[-1][:, leave]]
    for matrix in matrices[-2::-1]:
        ahead.append((matrix + ahead[-1][None, :]).max(axis=1))
    ahead = ahead[::-1][1:]
    states = [entry]
    for matrix, rest in zip(matrices, ahead, strict=False):
        states.append(int((matrix[states[-1]] + rest).argmax()))
    return [*states, leave]


def packed(matrix: np.ndarray) -> bytes:
    """A matrix behind its number of rows."""
    return np.array([len(matrix)], "<f8").tobytes() + matrix.astype("<f8").tobytes()


def _matrix(values: bytes) -> np.ndarray:
    numbers = np.frombuffer(values, "<f8")
    return numbers[1:].reshape(int(numbers[0]), -1)


def boundary_states(nodes: DataFrame) -> DataFrame:
    """``doc_id, k, entry, leave`` for the chunks k of each document, from their matrices ``m``.

    Up: products of ``FAN_IN`` neighbours until a document has at most that many
    nodes. Down: each group picks the states between its members, given those at
    its ends. A group has ``FAN_IN`` rows at most, however long a document is.
    """
    levels = [nodes]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) >= FAN_IN:

        def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            product = None
            for values in rows.sort_values("k")["m"]:
                product = _matrix(values) if product is None else times(product, _matrix(values))
            return pd.DataFrame({"doc_id": [key[0]], "k": [key[1]], "m": [packed(product)]})

        levels.append(stored(levels[-1].groupBy("doc_id", F.floor(F.col("k") / FAN_IN).alias("g")).applyInPandas(multiply, "doc_id long, k long, m binary")))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        states = best_states([_matrix(values) for values in rows["m"]], int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0]))
        return pd.DataFrame({"doc_id": rows["doc_id"], "k": rows["k"], "entry": states[:-1], "leave": states[1:]})

    known = levels[-1].select("doc_id", F.lit(0).cast("long").alias("g"), F.lit(0).alias("entry"), F.lit(0).alias("leave")).distinct()
    for level in reversed(levels):
        grouped = level.withColumn("g", F.floor(F.col("k") / FAN_IN)).join(known, ["doc_id", "g"])
        chosen = stored(grouped.groupBy("doc_id", "g").applyInPandas(choose, "doc_id long, k long, entry int, leave int"))
        known = chosen.withColumnRenamed("k", "g")
    return chosen


def _encode_short(texts: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            found = [table.encode(" " + text.replace(SPACE, " ")) if text else b"" for text in batch.column("text").to_pylist()]
            scores = pa.array([table.score(ids) for ids in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()), scores, pa.array([1] * len(found), pa.int32())], ["doc_id", "ids", "score", "n_chunks"])

    return texts.mapInArrow(run, "doc_id long, ids binary, score double, n_chunks int")


def _encode_giant(texts: DataFrame, model: str, chunk: int) -> DataFrame:
    width = pieces(model).longest
    if chunk < 2 * width:
        raise ValueError("a chunk must hold two of the longest piece")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                text = " " + text.replace(SPACE, " ")
                for number, at in enumerate(range(0, len(text), chunk)):
                    row = doc_id, number, text[at : at + chunk], text[max(0, at - width) : at], text[at + chunk : at + chunk + width]
                    yield pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(row, fields, strict=True)], schema=fields)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            matrices = [packed(table.transfer(*around)) for around in zip(*(batch.column(name).to_pylist() for name in ("text", "before", "ahead")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(matrices, pa.binary())], schema=fields.append(pa.field("m", pa.binary())))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for batch in batches:
            found = [table.trace(*given) for given in zip(*(batch.column(name).to_pylist() for name in ("text", "before", "ahead", "entry", "leave")), strict=True)]
            scores = pa.array([table.score(ids) for ids in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(found, pa.binary()), scores], ["doc_id", "k", "ids", "score"])

    fields = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("before", pa.string()), ("ahead", pa.string())])
    kinds = "doc_id long, k long, text string, before string, ahead string"
    # Chunks are few and dear: a stated number of partitions is not merged, however small they are.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = texts.mapInArrow(cut, kinds).repartition(tasks, "doc_id", "k")
    measured = stored(chunks.mapInArrow(measure, f"{kinds}, m binary"))
    states = boundary_states(measured.select("doc_id", "k", "m"))
    traced = measured.drop("m").join(states, ["doc_id", "k"]).repartition(tasks, "doc_id", "k").mapInArrow(trace, "doc_id long, k long, ids binary, score double")
    inside = F.array_sort(F.collect_list(F.struct("k", F.hex("ids").alias("ids"))))
    return traced.groupBy("doc_id").agg(
        F.unhex(F.array_join(F.transform(inside, lambda p: p["ids"]), "")).alias("ids"), F.sum("score").alias("score"), F.count("*").cast("int").alias("n_chunks")
    )


def encode(docs: DataFrame, model: str = MODEL, giant_bytes: int = GIANT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids, score, n_chunks``: the ids that the model itself gives each whole text, and their sum of piece scores.

    Spaces become marks behind a dummy prefix, nothing else is normalised; a
    character without a piece becomes its bytes. The encoding is the one path of
    pieces whose neighbours all fit, the best in the max-plus sense for being
    the only one that is not ruled out. Texts over ``giant_bytes`` are
    cut into chunks of ``chunk`` characters that any task may take: their
    transfer matrices between the pieces at their ends are combined as a scan,
    then each chunk is traced back on its own. There being one path, the ids do
    not depend on the cuts.

    A null or empty text has no ids. Rows without doc_id are left out, rows
    repeating one are one document, other columns are ignored, an empty table
    gives no rows.
    """
    texts = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    giant = F.coalesce(F.octet_length("text") > giant_bytes, F.lit(False))
    return _encode_short(texts.filter(~giant), model).union(_encode_giant(texts.filter(giant), model, chunk))


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of binary ids, without the dummy prefix."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        table = pieces(model)
        return pa.array([None if v is None else table.decode(v)[1:].decode(errors="replace") for v in values.to_pylist()], pa.string())

    return run(ids)
