"""Repeated passages found by a depth-limited radix sort of suffixes, most significant digit first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, free_name, identified, stored
from pagemill.llm.hashing import mixed, prefix_sums

WINDOW = 100
FIRST_DIGIT = 40
BATCH_BYTES = 1 << 19

def anchors(texts: list[bytes], window: int = WINDOW, digit: int = FIRST_DIGIT) -> tuple[np.ndarray, ...]:
    """Suffix classes of all windows of some texts by their first digit.

    The first digit of a window is the ``digit``-byte string with the least hash
    in it, the leftmost of equals; it is a function of the window's bytes, so
    equal windows have it, and at the same place. Neighbouring windows mostly
    share it, so a row stands for a run of windows. Returns for each run: hash of
    the digit, hash of all bytes the run's windows cover, number of the text,
    start of the first window, how many windows, where in them the digit starts.
    """
    lengths = np.array([len(text) for text in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = len(data)
    if size < window:
        return tuple(np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums, down = prefix_sums(data)
    digits = mixed((sums[digit:] - sums[:-digit]) * down[: size - digit + 1])
    least = digits & ~np.uint64(0xFFFFFFFF) | np.arange(len(digits), dtype=np.uint64)
    wanted, width = window - digit + 1, 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: width - wanted], least[wanted - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, np.arange(len(place)), side="right")
    inside = np.flatnonzero(np.arange(len(place)) + window <= ends[owner])
    if not len(inside):
        return anchors([], window, digit)
    place = place[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(fresh)
    low, high, place = inside[first], inside[np.append(first[1:], len(inside)) - 1], place[first]
    block = mixed((sums[high + window] - sums[low]) * down[low])
    owner = owner[low]
    return digits[place], block, owner, low - (ends - lengths)[owner], high - low + 1, place - low


def _groups(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Slices of a batch that hold few bytes, a long text alone."""
    at = 0
    while at < len(ids):
        stop, size = at, 0
        while stop < len(ids) and (stop == at or size + len(texts[stop]) <= BATCH_BYTES):
            size += len(texts[stop])
            stop += 1
        yield ids[at:stop], texts[at:stop]
        at = stop


def _runs(texts: DataFrame, window: int, digit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = (column.to_pylist() for column in batch.columns)
            for some, part in _groups(ids, [value or b"" for value in values]):
                key, block, owner, start, count, _ = anchors(part, window, digit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), pa.array(np.array(some, np.int64)[owner]), pa.array(start), pa.array(count.astype(np.int32))],
                    ["digit", "block", "doc_id", "start", "n"],
                )

    return texts.mapInArrow(run, "digit long, block long, doc_id long, start long, n int")


def _bodies(texts: DataFrame, window: int, digit: int) -> DataFrame:
    """``doc_id, start, n, lead, body`` of the runs whose first window is in ``starts``.

    ``body`` holds the bytes of all windows of the run, and its first digit
    stands ``lead`` bytes after the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, starts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                chosen = set(starts)
                for start, count, lead in zip(*(part.tolist() for part in anchors([text], window, digit)[3:]), strict=True):
                    if start in chosen:
                        rows.append((doc_id, start, count, lead, text[start : start + count - 1 + window]))
            for at in range(0, len(rows), 2048):
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 2048], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n", "lead", "body"])

    return texts.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, start long, n int, lead int, body binary")


def _cells(runs: DataFrame, size: int, window: int) -> DataFrame:
    """Runs cut by where the first digit stands in a window, ``size`` places at a time, with the digit of each part.

    All windows of a part share ``window - size + 1`` bytes around the first
    digit: the part's digit. With size 1 it is the window itself.
    """
    cell = F.explode(F.sequence(F.floor((F.col("lead") - F.col("n") + 1) / size), F.floor(F.col("lead") / size))).alias("cell")
    cut = runs.select("doc_id", "start", "n", "lead", "body", cell)
    high, low = F.least(F.col("lead"), (F.col("cell") + 1) * size - 1), F.greatest(F.col("lead") - F.col("n") + 1, F.col("cell") * size)
    cut = cut.withColumns({"high": high.cast("int"), "low": low.cast("int"), "skip": (F.col("lead") - high).cast("int")})
    part = cut.select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        (F.col("high") - F.col("low") + 1).alias("n"),
        F.col("high").alias("lead"),
        F.substring("body", F.col("skip") + 1, F.col("high") - F.col("low") + window).alias("body"),
        F.substring("body", (F.col("lead") - F.col("cell") * size + 1).cast("int"), F.lit(window - size + 1)).alias("key"),
    )
    # 128 bits stand for the bytes of a part; the hash is taken plain and behind a prefix.
    return part.select(F.xxhash64("key").alias("digit"), F.xxhash64("body").alias("block"), F.xxhash64(F.lit("second"), "body").alias("check"), "doc_id", "start", "n", "lead", "body")


def _joined(rows: DataFrame, same: list[str]) -> DataFrame:
    """One radix pass over ``digit, *same, doc_id, start``: adds ``is_first`` and ``is_open``.

    Rows with equal ``same`` hold equal windows: all but the first are repeats.
    First ones whose digit also stands in other blocks are open, for the next
    pass; whatever is alone in its digit drops out. Groups are combined in the
    map tasks and joined back, never gathered.
    """
    firsts = rows.groupBy("digit", *same).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("copies"))
    several = firsts.groupBy("digit").agg(F.count("*").alias("blocks"))
    known = firsts.join(several, "digit").filter("copies > 1 OR blocks > 1")
    joined = rows.join(known, ["digit", *same]).withColumn("is_first", F.struct("doc_id", "start") == F.col("first"))
    return joined.withColumn("is_open", F.expr("is_first AND blocks > 1")).drop("digit", *same, "first", "copies", "blocks")


def repeated_spans(docs: DataFrame, window: int = WINDOW, digit: int = FIRST_DIGIT) -> DataFrame:
    """``doc_id, start, stop``: byte spans whose windows all also start earlier; spans may overlap.

    Earlier is a smaller doc_id, or the same document and an earlier start. Each
    pass takes a longer digit, up to the whole window, and carries on only the
    first suffixes of groups that its digit did not tell apart.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    runs = _runs(texts, window, digit)
    several = runs.groupBy("digit").agg(F.count("*").alias("_n")).filter("_n > 1").select("digit")
    survivors = stored(runs.join(several, "digit", "left_semi"), release=True)
    passes = [stored(_joined(survivors, ["block"]), release=True)]
    discard(survivors)

    starts = passes[0].filter("is_open").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    open_runs = bodies = stored(_bodies(texts.join(starts, "doc_id"), window, digit), release=True)
    for share in (2, 8, window):
        cells = _cells(open_runs, max(1, (window - digit) // share), window)
        sorted_cells = _joined(cells, ["block", "check"]).withColumn("body", F.when(F.col("is_open"), F.col("body")))  # others are done
        passes.append(stored(sorted_cells, release=True))
        open_runs = passes[-1].filter("is_open")
    discard(bodies)

    result = None
    for table in passes:
        part = table.filter("NOT is_first").select("doc_id", "start", (F.col("start") + F.col("n") - 1 + window).alias("stop"))
        result = part if result is None else result.union(part)
    spans = stored(result, release=True)
    for table in passes:
        discard(table)
    return spans


def _without(whole_characters: bool) -> Callable[..., Column]:
    """Column function of a binary text and its spans: length, remaining bytes and the maximal removed runs."""
    runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    @F.arrow_udf("n_bytes long, kept binary, spans array<struct<start: long, stop: long>>")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        sizes, kept, removed = [], [], []
        for text, found in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for start, stop in sorted((span["start"], span["stop"]) for span in found or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            edges = [0, *(edge for span in merged for edge in span), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            sizes.append(len(text))
            kept.append(rest.decode(errors="ignore").encode() if whole_characters else rest)
            removed.append([{"start": start, "stop": stop} for start, stop in merged])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, runs)], ["n_bytes", "kept", "spans"])

    return cut


def _cut(unique: DataFrame, window: int, digit: int, whole_characters: bool) -> tuple[DataFrame, str]:
    """The documents with one more column, the cut text, and that column's name."""
    cuts_name, cut_name, key = (free_name(unique, stem) for stem in ("_cuts", "_cut", "_doc_id"))
    spans = repeated_spans(unique.select("doc_id", "text"), window, digit)
    cuts = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "stop")).alias(cuts_name))
    joined = unique.join(cuts, F.col("doc_id") == F.col(key), "left")
    return joined.withColumn(cut_name, _without(whole_characters)(F.col("text").cast("binary"), cuts_name)), cut_name


def remove_repeats(docs: DataFrame, window: int = WINDOW, digit: int = FIRST_DIGIT) -> DataFrame:
    """``doc_id, n_bytes, kept, spans``: every text without its repeated windows.

    A byte goes if a ``window``-byte string that also starts earlier covers it,
    judged on the input. ``kept`` is binary, for a cut may fall inside a
    character; ``spans`` lists the maximal removed runs as (start, stop). A null
    text is empty; a text shorter than a window keeps all. Rows without doc_id
    are left out, rows repeating one are one document, other columns are
    ignored, an empty table gives no rows.
    """
    cut, name = _cut(identified(docs.select("doc_id", "text")), window, digit, whole_characters=False)
    return cut.select("doc_id", f"{name}.*")


def drop_repeats(docs: DataFrame, window: int = WINDOW, digit: int = FIRST_DIGIT) -> DataFrame:
    """The documents with the repeats taken out of ``text``, all columns kept.

    As ``remove_repeats``; a character that a cut goes through is dropped, a null text stays null.
    """
    cut, cut_name = _cut(identified(docs), window, digit, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col(f"{cut_name}.kept").cast("string")).alias("text")
    return cut.select(*[text if name == "text" else F.col(f"`{name}`") for name in docs.columns])
