"""Hard negatives by threshold joins with suffix-norm bounds, thresholds lowered until the windows fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import identified, stored

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH, WHOLE = 80, 100, 100
BLOCK_ROWS = 2048
ANCHOR_BATCH = 4096
ANCHOR_SLICE = 256
CHUNK = 8
#: Cosine to a vector of middling length; the last threshold takes everything.
POSITIVE_LEVELS = (0.9, 0.6, 0.3, -np.inf)
#: Share of the way from a positive's score down to its window's end.
NEGATIVE_LEVELS = (0.25, 0.6, 1.0)


def whole_vectors(embedding: Column, scale: int = 256) -> Column:
    """Each component as the floor of ``scale`` times itself; null unless all are there and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def _rest_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of what follows each chunk of dimensions, before the first one included."""
    squares = np.add.reduceat(rows * rows, np.arange(0, rows.shape[1], CHUNK), axis=1)
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([after, np.zeros((len(rows), 1))], axis=1)) * (1 + 1e-12)


def threshold_join(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of all pairs with a score of at least the anchor's threshold.

    Dimensions come in chunks, the strongest first. The inverted index lists a
    row under a chunk only as long as the norms of what follows could reach the
    least threshold; the omitted dimensions are left to the final check. Partial
    scores grow chunk by chunk, and a row is given up when its score so far and
    the remaining norms reach no anchor's threshold. Scores of pairs that
    remain are completed over all dimensions.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(rows) or not len(anchors):
        return empty
    chunks = -(-rows.shape[1] // CHUNK)
    row_rest, anchor_rest = _rest_norms(rows), _rest_norms(anchors)
    covered = row_rest * anchor_rest.max(axis=0) < least.min()
    listed = np.where(covered.any(axis=1), covered.argmax(axis=1), chunks)  # under how many chunks a row is listed
    alive = np.flatnonzero(listed > 0)
    partial = np.zeros((len(anchors), len(alive)))
    for chunk in range(chunks):
        here = listed[alive] > chunk
        if not here.any():
            break
        span = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        partial[:, here] += anchors[:, span] @ rows[alive[here], span].T
        done = np.minimum(listed[alive], chunk + 1)
        reach = partial + anchor_rest[:, done] * row_rest[alive, done] >= least[:, None]
        hopeful = reach.any(axis=0)
        if hopeful.sum() < 0.8 * len(alive):
            alive, partial = alive[hopeful], partial[:, hopeful]
    if not len(alive):
        return empty
    done = listed[alive]
    anchor, place = np.nonzero(partial + anchor_rest[:, done] * row_rest[alive, done] >= least[:, None])
    row = alive[place]
    score = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = np.einsum("ij,ij->i", anchors[anchor[part]], rows[row[part]])
    keep = score >= least[anchor]
    return anchor[keep], row[keep], score[keep]


def _first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    fresh = np.flatnonzero(np.diff(ordered, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(fresh, np.diff(np.append(fresh, len(order))))
    return order[rank < most]


def _packed(vectors: DataFrame, order: np.ndarray) -> DataFrame:
    """Blocks of one label each: ids and the vectors, dimensions in the given order; short vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, ids, rows = None, [], []

        def block() -> pa.RecordBatch:
            matrix = np.zeros((len(rows), len(order)))
            for place, row in enumerate(rows):
                matrix[place, : len(row)] = row
            kind = "<i4" if not matrix.size or np.abs(matrix).max() < 1 << 31 else "<f8"
            columns = [pa.array([label], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([kind]), pa.array([matrix[:, order].astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["label", "ids", "kind", "vectors"])

        for batch in batches:
            for vec_id, its_label, vector in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector"), strict=True):
                if rows and (its_label != label or len(rows) >= BLOCK_ROWS):
                    yield block()
                    ids, rows = [], []
                label = its_label
                ids.append(vec_id)
                rows.append(vector.values.to_numpy())
        if rows:
            yield block()

    # The hash splits a label of any size; a range holds few labels, so its blocks are full.
    dealt = vectors.repartitionByRange("label", F.xxhash64("vec_id")).sortWithinPartitions("label")
    return stored(dealt.select("vec_id", "label", "vector").mapInArrow(run, "label long, ids array<long>, kind string, vectors binary"))


class Anchors:
    """A batch of anchors, in memory: a bounded number of rows."""

    def __init__(self, rows: pa.Table, order: np.ndarray):
        self.ids = rows["vec_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.vectors = np.zeros((len(self.ids), len(order)))
        for place, vector in enumerate(rows["vector"].to_pylist()):
            self.vectors[place, : len(vector)] = vector
        self.vectors = self.vectors[:, order]
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))


def _joined(blocks: DataFrame, search: Callable[[int, np.ndarray, np.ndarray], Iterator[tuple]], names: list[str]) -> DataFrame:
    """Run ``search`` on every block; it yields the columns of its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, ids, kind, vectors in zip(*(batch.column(name) for name in ("label", "ids", "kind", "vectors")), strict=True):
                found = ids.values.to_numpy()
                rows = np.frombuffer(vectors.as_py(), kind.as_py()).reshape(len(found), -1).astype(float)
                for columns in search(label.as_py(), found, rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return blocks.mapInArrow(run, ", ".join(f"{name} long" for name in names))


def _positives(blocks: DataFrame, anchors: Anchors, middling: float, most: int) -> tuple[np.ndarray, ...]:
    """Anchor number, positive's id and score: the ``most`` best rows of the same label for each anchor of the batch."""
    context, open_ones, found = blocks.sparkSession.sparkContext, np.arange(len(anchors.ids)), []
    for level in POSITIVE_LEVELS:
        least = level * middling * anchors.norms if np.isfinite(level) else np.full(len(anchors.ids), level)
        shared = context.broadcast((anchors, open_ones, least))

        def search(label: int, ids: np.ndarray, rows: np.ndarray, shared=shared) -> Iterator[tuple]:
            anchors, wanted, least = shared.value
            some = wanted[anchors.labels[wanted] == label]
            for at in range(0, len(some), ANCHOR_SLICE):
                part = some[at : at + ANCHOR_SLICE]
                anchor, row, score = threshold_join(rows, anchors.vectors[part], least[part])
                other = ids[row] != anchors.ids[part[anchor]]
                anchor, row, score = part[anchor[other]], row[other], score[other]
                keep = _first_of_each(anchor, score, ids[row], most)
                yield anchor[keep], ids[row[keep]], score[keep]

        rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
        best = _joined(blocks, search, ["anchor", "vec_id", "score"]).withColumn("rank", rank).filter(F.col("rank") <= most)
        table = best.orderBy("anchor", "rank").toArrow()
        anchor = table["anchor"].to_numpy()
        full = np.bincount(anchor, minlength=len(anchors.ids)) >= most
        use = full[anchor] | (level == POSITIVE_LEVELS[-1])
        found.append([table[name].to_numpy()[use] for name in ("anchor", "vec_id", "score")])
        open_ones = open_ones[~full[open_ones]]
        if not len(open_ones):
            break
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _negatives(blocks: DataFrame, anchors: Anchors, windows: tuple[np.ndarray, ...], most: int, low: int, high: int, whole: int) -> list[DataFrame]:
    """The best rows of other labels in the window below each (anchor, positive), a table for each threshold."""
    context, (anchor_of, positive, top) = blocks.sparkSession.sparkContext, windows
    floor, ceiling = -((-low * top) // whole), (high * top) // whole
    open_ones, tables = np.flatnonzero(floor <= ceiling), []
    for level in NEGATIVE_LEVELS:
        if not len(open_ones):
            break
        least = floor if level == 1 else np.maximum(floor, np.floor(ceiling - level * (ceiling - floor)).astype(np.int64))
        ordered = open_ones[np.argsort(anchor_of[open_ones], kind="stable")]
        shared = context.broadcast((anchors, anchor_of[ordered], positive[ordered], top[ordered], least[ordered], ceiling[ordered]))

        def search(label: int, ids: np.ndarray, rows: np.ndarray, shared=shared) -> Iterator[tuple]:
            anchors, anchor_of, positive, top, least, ceiling = shared.value
            some = np.unique(anchor_of)
            some = some[anchors.labels[some] != label]
            for at in range(0, len(some), ANCHOR_SLICE):
                part = some[at : at + ANCHOR_SLICE]
                first, last = np.searchsorted(anchor_of, part), np.searchsorted(anchor_of, part, side="right")
                lowest = np.array([least[a:b].min() for a, b in zip(first, last, strict=True)], float)
                anchor, row, score = threshold_join(rows, anchors.vectors[part], lowest)
                for step in range(int((last - first).max())):  # the windows of an anchor, one after another
                    window = np.minimum(first + step, len(anchor_of) - 1)[anchor]
                    inside = (first[anchor] + step < last[anchor]) & (score >= least[window]) & (score <= ceiling[window])
                    keep = _first_of_each(window[inside], score[inside], ids[row[inside]], most)
                    chosen, rows_kept, scores = window[inside][keep], row[inside][keep], score[inside][keep]
                    yield anchors.ids[anchor_of[chosen]], positive[chosen], top[chosen], ids[rows_kept], scores

        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        within = Window.partitionBy("anchor_id", "positive_id")
        rank = F.row_number().over(within.orderBy(F.desc("negative_score"), "negative_id"))
        ranked = _joined(blocks, search, names).withColumn("rank", rank).filter(F.col("rank") <= most)
        table = stored(ranked)
        if level == NEGATIVE_LEVELS[-1]:
            tables.append(table)
            break
        full = table.filter(F.col("rank") == most).select("anchor_id", "positive_id")
        tables.append(table.join(full, ["anchor_id", "positive_id"], "left_semi"))
        done = full.toArrow()
        pairs = set(zip(done["anchor_id"].to_pylist(), done["positive_id"].to_pylist(), strict=True))
        open_ones = np.array([k for k in open_ones.tolist() if (int(anchors.ids[anchor_of[k]]), int(positive[k])) not in pairs], np.int64)
    return tables


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, whole: int = WHOLE, anchor_batch: int = ANCHOR_BATCH
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vec_id, label, vector`` rows.

    A vector is an array of whole numbers, the score its inner product with the
    anchor. An anchor's positives are its best rows of the same label; for each,
    the best rows of other labels follow whose score is from ``low`` to ``high``
    parts in ``whole`` of the positive's. Equal scores go by vec_id.

    All rows are packed once into blocks of one label. Anchors are taken in
    batches of about ``anchor_batch`` by a hash of their id; a batch is
    broadcast, and every block is joined to it at a threshold. Where too few
    rows pass, the threshold is lowered and the blocks are joined again, down to
    the end of the window (for positives: to everything), so the result is exact.
    A task holds one block and a slice of the batch; it gives on no more than the
    rows that a window takes.

    Rows with a null id, label or vector take no part, rows repeating an id are
    one, vectors of different lengths end in zeros, a window that ends below its
    start (a negative positive score) is empty, an empty table gives no rows.
    Scores are exact up to 2^53.
    """
    spark = vectors.sparkSession
    unique = stored(identified(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector").dropna(), "vec_id"))
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    by_place = unique.select(F.posexplode("vector").alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("double") ** 2).alias("energy")).toArrow()
    energy = np.zeros(max(by_place["place"].to_pylist(), default=-1) + 1)
    if not len(energy):
        energy = np.zeros(1)
    energy[by_place["place"].to_numpy()] = by_place["energy"].to_numpy()
    order = np.argsort(-energy, kind="stable")
    chosen = unique.filter(is_anchor)
    n_rows, n_anchors = unique.agg(F.count("*"), F.count_if(is_anchor)).first()
    if not n_anchors:
        return result
    middling = float(np.sqrt(energy.sum() / n_rows))
    blocks, batches = _packed(unique, order), -(-n_anchors // anchor_batch)
    for number in range(batches):
        rows = chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == number).orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        anchors = Anchors(rows, order)
        windows = _positives(blocks, anchors, middling, positives)
        for table in _negatives(blocks, anchors, windows, negatives, low, high, whole):
            result = result.union(table.select(*[F.col(name).cast(kind).alias(name) for name, kind in result.dtypes]))
    return result
