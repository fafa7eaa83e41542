"""Near-duplicate embeddings found on a robust-pruned flat graph built over overlapping shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, identified, stored

MIN_COSINE = 0.98
OVERLAP = 3
PIVOT_ROWS = 300
MAX_PIVOTS = 4096
SHARD_ROWS = 4096
SMALL_LABEL = 1500
DEGREE, CANDIDATES, LONG_EDGES, ALPHA = 16, 32, 8, 1.2
BEAM, MEDOIDS = 16, 8
QUERY_BLOCK = 256
ROW_BLOCK = 512
FRONTIER = 1 << 14


def _vectors(rows: pd.Series) -> np.ndarray:
    """Unit vectors in double precision."""
    values = np.stack(rows.to_numpy()).astype(np.float64)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the vectors that may link: label known, all components finite, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad & some)


def robust_prune(sims: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Out-edges (row numbers, -1 for none) of each vector of a shard from all cosines in it.

    Candidates are the nearest vectors and some at fixed pseudo-random places,
    nearest first. A chosen one removes those it is ``alpha`` times closer to
    than the vector itself, so edges point to different sides and some stay long.
    """
    n = len(sims)
    if n < 2:
        return np.full((n, 0), -1, np.int64)
    far = np.random.default_rng(n).integers(0, n, (n, LONG_EDGES))
    return np.concatenate([_pruned_rows(sims, np.arange(at, min(n, at + ROW_BLOCK)), far[at : at + ROW_BLOCK], degree, candidates, alpha) for at in range(0, n, ROW_BLOCK)])


def _pruned_rows(sims: np.ndarray, own: np.ndarray, far: np.ndarray, degree: int, candidates: int, alpha: float) -> np.ndarray:
    """``robust_prune`` for some rows; what it holds beside ``sims`` grows with them only."""
    n, rows, every = len(sims), own[:, None], np.arange(len(own))
    masked = sims[own].astype(np.float64)
    masked[every, own] = -np.inf
    near = min(candidates, n - 1)
    nearest = np.argpartition(-masked, near - 1, axis=1)[:, :near]
    pool = np.concatenate([nearest, far], axis=1)
    pool = pool[every[:, None], np.argsort(-masked[every[:, None], pool], axis=1, kind="stable")]
    away = np.sqrt(np.maximum(0, 2 - 2 * sims[rows, pool].astype(np.float64)))
    alive = pool != rows
    chosen = np.full((len(own), degree), -1, np.int64)
    for k in range(degree):
        first = alive.argmax(axis=1)
        there = alive[every, first]
        if not there.any():
            break
        pick = pool[every, first]
        chosen[there, k] = pick[there]
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[pick[:, None], pool].astype(np.float64)))
        alive &= ~(there[:, None] & ((alpha * between <= away) | (pool == pick[:, None])))
    return chosen


def _greedy(vectors: np.ndarray, edges: np.ndarray, queries: np.ndarray, medoids: np.ndarray) -> np.ndarray:
    """Beam search for a block of queries at once; returns the beam of each, nearest first, -1 for none."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n), bool)
    beam = np.full((q, BEAM), -1, np.int64)
    score, done = np.full((q, BEAM), -np.inf), np.ones((q, BEAM), bool)
    new = np.tile(medoids, (q, 1))
    rows = np.arange(q)[:, None]
    for _ in range(2 * BEAM):
        fresh = (new >= 0) & ~seen[rows, np.maximum(new, 0)]
        seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
        gained = np.full(new.shape, -np.inf)
        place = np.nonzero(fresh)
        gained[place] = np.einsum("ij,ij->i", queries[place[0]], vectors[new[place]])
        pool, values = np.concatenate([beam, new], axis=1), np.concatenate([score, gained], axis=1)
        flags = np.concatenate([done, ~fresh], axis=1)
        order = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
        beam, score, done = pool[rows, order], values[rows, order], flags[rows, order]
        beam = np.where(np.isfinite(score), beam, -1)
        if done.all():
            break
        first = (~done).argmax(axis=1)
        open_ = ~done[np.arange(q), first]
        done[np.arange(q), first] = True
        new = np.where(open_[:, None], edges[np.maximum(beam[np.arange(q), first], 0)], -1)
    return beam


def range_search(vectors: np.ndarray, edges: np.ndarray, wanted: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, found row) with at least ``min_cosine``, block by block.

    Each query walks greedily from the medoids, then widens: all neighbours of
    everything in range are looked at, until nothing in range is new. A query is
    in the graph itself, so the widening also starts from its own place.
    """
    centre = vectors.mean(axis=0)
    medoids = np.argsort(-(vectors @ centre), kind="stable")[:1]
    spread = np.linspace(0, len(vectors) - 1, MEDOIDS).astype(np.int64)
    medoids = np.unique(np.concatenate([medoids, spread]))
    for at in range(0, len(wanted), QUERY_BLOCK):
        block = wanted[at : at + QUERY_BLOCK]
        beam = _greedy(vectors, edges, vectors[block], medoids)
        looked = np.zeros((len(block), len(vectors)), bool)
        inside = np.zeros_like(looked)

        def look(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Compare what has not been looked at; returns what is in range."""
            fresh = ~looked[who, what]
            code = np.unique(who[fresh] * len(vectors) + what[fresh])
            who, what = code // len(vectors), code % len(vectors)
            looked[who, what] = True
            close = np.einsum("ij,ij->i", vectors[block[who]], vectors[what]) >= min_cosine
            who, what = who[close], what[close]
            inside[who, what] = True
            return who, what

        who, what = look(np.concatenate([np.arange(len(block)), np.nonzero(beam >= 0)[0]]), np.concatenate([block, beam[beam >= 0]]))
        while len(who):
            steps = []
            for part in range(0, len(who), FRONTIER):  # a dense group has a frontier of very many pairs
                follow = edges[what[part : part + FRONTIER]]
                near = follow >= 0
                steps.append(look(np.repeat(who[part : part + FRONTIER], follow.shape[1])[near.ravel()], follow[near]))
            who, what = (np.concatenate(some) for some in zip(*steps, strict=True))
        found = np.nonzero(inside)
        yield block[found[0]], found[1]


def _local_roots(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest row joined to each row, given the roots so far and more links."""
    while True:
        low = np.minimum(root[left], root[right])
        following = root.copy()
        np.minimum.at(following, root[left], low)
        np.minimum.at(following, root[right], low)
        following = following[following]
        if (following == root).all():
            return root
        root = following


def apart(pivots: np.ndarray, min_cosine: float = MIN_COSINE) -> np.ndarray:
    """The pivots without those that would link with an earlier one.

    A dense group then has one pivot and lies in its shard as a whole, where
    several would part it.
    """
    kept = np.empty_like(pivots)
    many = 0
    for pivot in pivots:
        if not many or (kept[:many] @ pivot).max() < min_cosine:
            kept[many] = pivot
            many += 1
    return kept[:many]


def shards(nodes: DataFrame) -> DataFrame:
    """Nodes with their shards: ``key, mine`` once per shard, ``shards`` all of a node's.

    A label with few vectors is a shard. In the others each vector goes to the
    shards of its ``OVERLAP`` nearest pivots; pivots are the vectors with the
    least id hashes, one in ``PIVOT_ROWS`` but at most about ``MAX_PIVOTS``, the
    bound of what is broadcast, without those near another. Shards over ``SHARD_ROWS`` are dealt into blocks
    that meet in pairs, so no task holds more than two blocks.
    """
    group = [F.col("label"), F.size("embedding").alias("size")]
    sizes = nodes.groupBy(*group).agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > SMALL_LABEL).select("label", "size")
    total = sizes.filter(F.col("n") > SMALL_LABEL).agg(F.sum("n")).first()[0] or 0
    share = 1 / max(PIVOT_ROWS, total / MAX_PIVOTS)
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = nodes.filter(hashed).withColumn("size", F.size("embedding")).join(large, ["label", "size"]).select("label", "embedding").orderBy("vec_id").limit(2 * MAX_PIVOTS)
    pivots: dict[tuple, list] = {}
    for row in sample.collect():
        pivots.setdefault((row["label"], len(row["embedding"])), []).append(row["embedding"])
    packed = {}
    start = 0
    for name, values in sorted(pivots.items()):
        matrix = np.array(values)
        matrix = apart(matrix / np.linalg.norm(matrix, axis=1, keepdims=True))
        packed[name] = (start, matrix)
        start += len(matrix)
    shared = nodes.sparkSession.sparkContext.broadcast(packed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = np.empty(len(rows), object)
            keys = list(zip(rows["label"], rows["embedding"].map(len), strict=True))
            for name in set(keys):
                mine = np.array([key == name for key in keys])
                if name not in shared.value:
                    for k in np.flatnonzero(mine):
                        found[k] = [-1]
                    continue
                first, matrix = shared.value[name]
                sims = _vectors(rows["embedding"][mine]) @ matrix.T
                top = np.argsort(-sims, axis=1, kind="stable")[:, :OVERLAP]
                for k, chosen in zip(np.flatnonzero(mine), top, strict=True):
                    found[k] = sorted((first + chosen).tolist())
            yield rows.assign(shards=found)

    kept = "vec_id long, label long, embedding array<double>, copies long"
    assigned = stored(nodes.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", "copies").mapInPandas(assign, f"{kept}, shards array<long>"))
    members = assigned.withColumn("shard", F.explode("shards")).withColumn("size", F.size("embedding"))
    counts = members.groupBy("label", "size", "shard").agg(F.ceil(F.count("*") * 2 / SHARD_ROWS).alias("blocks"))
    counts = counts.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    dealt = members.join(counts, ["label", "size", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return met.select(
        "vec_id", "embedding", "copies", "shards", "shard", "block",
        F.struct("label", "size", "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("key"),
    )


def _adjacency(members: DataFrame) -> DataFrame:
    """``vec_id, edges``: out-edges of all shards together, and their reverses."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = rows["vec_id"].to_numpy(), _vectors(rows["embedding"])
        single = vectors.astype(np.float32)
        chosen = robust_prune(single @ single.T if len(ids) > 1 else np.ones((1, 1)))
        left, right = np.nonzero(chosen >= 0)[0], chosen[chosen >= 0]
        both = pd.DataFrame({"vec_id": np.concatenate([ids[left], ids[right]]), "edge": np.concatenate([ids[right], ids[left]])})
        return both.groupby("vec_id")["edge"].agg(list).reset_index().rename(columns={"edge": "edges"})

    lists = members.select("key", "vec_id", "embedding").groupBy("key").applyInPandas(build, "vec_id long, edges array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))


def near_duplicates(table: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors with equal labels and a cosine of at least ``min_cosine`` link, as
    far as the search finds them (``audit_recall`` measures it; pairs without a
    common shard are the ones that may be missed). Every link is verified in
    double precision. Equal vectors are one node with a count. A pair is counted
    in the first shard both are in, and a shard hands on one link per node for
    the components, so the pairs of a dense group are never written out.

    A vector that is null, zero or not finite, or has a null in it or no label, links with
    nothing. Rows without vec_id are left out, rows repeating one are one
    vector, other columns are ignored, an empty table gives no rows.
    """
    every = identified(table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "vec_id")
    able = usable(every)
    nodes = stored(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    members = stored(shards(nodes))
    linked = members.join(_adjacency(members), "vec_id", "left")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id").reset_index(drop=True)
        ids, vectors = rows["vec_id"].to_numpy(), _vectors(rows["embedding"])
        lists = [np.asarray(e if e is not None else [], np.int64) for e in rows["edges"]]
        flat, owner = np.concatenate([*lists, np.zeros(0, np.int64)]), np.repeat(np.arange(len(ids)), [len(e) for e in lists])
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[place] == flat
        owner, place = owner[here], place[here]
        column = np.arange(len(owner)) - np.searchsorted(owner, owner)
        edges = np.full((len(ids), int(column.max(initial=-1)) + 1), -1, np.int64)
        edges[owner, column] = place
        shard, block, copies = int(rows["shard"].iloc[0]), rows["block"].to_numpy(), rows["copies"].to_numpy()
        sets = np.stack(rows["shards"].to_numpy())
        cross = len(set(block.tolist())) > 1
        n_links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for left, right in range_search(vectors, edges, np.arange(len(ids)), min_cosine):
            use = (left != right) & ((block[left] != block[right]) if cross else True)
            left, right = left[use], right[use]
            for at in range(0, len(left), 1 << 16):
                a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
                root = _local_roots(len(ids), a, b, root)
                common = np.where((sets[a][:, :, None] == sets[b][:, None, :]).any(axis=2), sets[a], np.iinfo(np.int64).max).min(axis=1)
                first = common == shard
                n_links += np.bincount(a[first], copies[b[first]], len(ids)).astype(np.int64)
        return pd.DataFrame({"vec_id": ids, "found": n_links, "root": ids[root]})

    columns = ["key", "vec_id", "embedding", "copies", "shards", "shard", "block", "edges"]
    found = stored(linked.select(*columns).groupBy("key").applyInPandas(search, "vec_id long, found long, root long"))
    roots = components(found.filter("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
    links = found.groupBy("vec_id").agg(F.sum("found").alias("found"))
    rated = nodes.join(links, "vec_id").join(roots, "vec_id", "left")
    rated = rated.select("label", "embedding", (F.col("found") + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    result = able.join(rated, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return every.select("vec_id").join(result, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def audit_recall(table: DataFrame, result: DataFrame, min_cosine: float = MIN_COSINE, every: int = 50, block: int = 64) -> float:
    """Share of the true links of the vectors whose id is divisible by ``every`` that ``result`` counts.

    The queries are compared with all vectors in blocks: each block of queries
    joins the vectors of its label.
    """
    able = usable(identified(table.select("vec_id", "label", "embedding"), "vec_id"))
    asked = able.filter(F.col("vec_id") % every == 0).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(block)))
    blocks = asked.groupBy("label", "b").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for vec_id, vector, queries in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                fitting = [q for q in queries if len(q["embedding"]) == len(vector) and q["vec_id"] != vec_id]
                if not fitting:
                    continue
                matrix, own = np.array([q["embedding"] for q in fitting]), np.array(vector)
                close = matrix @ own / (np.linalg.norm(matrix, axis=1) * np.linalg.norm(own)) >= min_cosine
                ids += [q["vec_id"] for q, hit in zip(fitting, close, strict=True) if hit]
                counts += [1] * int(close.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["vec_id", "n"])

    truth = able.join(blocks, "label").select("vec_id", "embedding", "queries").mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    sums = truth.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")).alias("hit"), F.sum("n").alias("all")).first()
    return 1.0 if not sums["all"] else sums["hit"] / sums["all"]
