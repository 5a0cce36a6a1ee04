"""Nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test.

Vectors are scaled to length 1, so that the order by cosine is the order by
Euclidean distance, and projected to a few dimensions with Gaussian (2-stable)
weights: for a pair at distance d, the squared projected distance over d^2 is
chi-square distributed with as many degrees of freedom as dimensions. Each shard
of the rows has a kd-tree over its projections. A query takes projected
neighbours nearest first, verifies them on the original vectors, and stops when
a vector closer than its k-th best would by now have been met with the wanted
probability.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

DIMS = 24
PROBABILITY = 0.93
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
_LEAF = 64
_SEED = 20_240


def chi2_cdf(x: float, dims: int) -> float:
    """The chi-square distribution function, for an even number of degrees of freedom."""
    half = min(x, 1e3) / 2
    term = total = math.exp(-half)
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1 - total


def chi2_limit(probability: float, dims: int) -> float:
    """Where the distribution function reaches a probability, by halving."""
    low, high = 0.0, 1e3
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dims) < probability else (low, middle)
    return high


def projection(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((width, dims))


class Tree:
    """A kd-tree over points, split at medians of the widest side.

    A node is (axis, place, left, right), or (-1, 0, leaf's number, 0).
    """

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        self.points, self.nodes, self.leaves = points, [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= leaf or not spread.max() > 0:
                self.nodes.append([-1, 0.0, len(self.leaves), 0])
                self.leaves.append(rows)
                continue
            axis, half = int(spread.argmax()), len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            self.nodes.append([axis, float(points[rows[order[half]], axis]), 0, 0])
            todo += [(rows[order[half:]], at, 1), (rows[order[:half]], at, 0)]

    def neighbours(self, p: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(bound, rows, squared distances): leaves, nearest cell first; no row yet to come is nearer than the bound."""
        at = p.tolist()
        heap, count = [(0.0, 0, 0, (0.0,) * len(at))], 0
        while heap:
            far, _, n, off = heapq.heappop(heap)
            axis, place, left, right = self.nodes[n]
            while axis >= 0:
                gap = at[axis] - place
                near, other = (left, right) if gap < 0 else (right, left)
                away = far - off[axis] ** 2 + gap * gap
                count += 1
                if away >= far:
                    heapq.heappush(heap, (away, count, other, (*off[:axis], gap, *off[axis + 1 :])))
                else:
                    heapq.heappush(heap, (far, count, other, off))
                axis, place, left, right = self.nodes[near]
            rows = self.leaves[left]
            d = self.points[rows] - p
            yield heap[0][0] if heap else math.inf, rows, (d * d).sum(axis=1)


def _search(
    vecs: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, dims: int, probability: float
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query the k best of the shard: scores (cosines) and ids, and how many rows were verified.

    least: a score that k rows elsewhere reach.
    """
    norms, q_norms = (np.sqrt((x * x).sum(axis=1)) for x in (vecs, q))
    axes = projection(vecs.shape[1], dims)
    tree, probes = Tree((vecs / norms[:, None]) @ axes), (q / q_norms[:, None]) @ axes
    limit = chi2_limit(probability, dims)
    out = []
    for v, v_norm, p, me, floor in zip(q, q_norms, probes, own, least):
        waiting, distance = np.zeros(0, np.int64), np.zeros(0)
        score, found, verified = np.zeros(0), np.zeros(0, np.int64), 0

        def reach() -> float:
            """The squared projected distance within which a row nearer than the k-th best would be met."""
            kth = max(floor, score[-1] if len(score) == k else -1.0)  # noqa: B023
            return math.inf if kth <= -1.0 else limit * max(2 - 2 * kth, 1e-12)

        for bound, rows, d in tree.neighbours(p):
            waiting, distance = np.concatenate((waiting, rows)), np.concatenate((distance, d))
            ready = np.nonzero(distance <= bound)[0]
            if not len(ready):
                if bound > reach():
                    break
                continue
            ready = ready[np.argsort(distance[ready], kind="stable")]
            at = 0
            while at < len(ready) and distance[ready[at]] <= reach():
                step = ready[at : at + max(4 * k, at)]
                step = step[distance[step] <= reach()]
                at += len(step)
                rows = waiting[step]
                rows = rows[ids[rows] != me]
                verified += len(rows)
                # summed row by row, so that equal vectors have equal scores
                score = np.concatenate((score, (vecs[rows] * v).sum(axis=1) / (norms[rows] * v_norm)))
                found = np.concatenate((found, ids[rows]))
                keep = np.lexsort((found, -score))[:k]
                score, found = score[keep], found[keep]
            if at < len(ready) or bound > reach():
                break
            left = distance > bound
            waiting, distance = waiting[left], distance[left]
        out.append((score, found, verified))
    return out


def _taking_part(f: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by the vectors' length, repeated rows once.

    Vectors are scaled by powers of 2, which leaves cosines as they are and
    keeps squares finite.
    """
    by: dict[int, dict] = {}
    for i, x in zip(f["id"], f["v"]):
        v = np.array([np.nan if y is None else y for y in x], np.float64)
        if v.size and np.isfinite(v).all() and (v != 0).any():
            v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
            by.setdefault(v.size, {})[i, v.tobytes()] = v
    return {n: (np.array([i for i, _ in x], np.int64), np.array(list(x.values()))) for n, x in by.items()}


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dims: int = DIMS,
    probability: float = PROBABILITY,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    verified_col: str | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by cosine.

    A row with the query's own id is no candidate. Equal scores come by smaller
    id. Vectors that are null, empty, zero or hold null or non-finite parts, and
    rows without an id, take no part; vectors of another length than the query's
    are no candidates of it; with fewer than k candidates all are returned. Every
    row is in a shard's tree, and blocks of queries meet each shard in turn; both
    are of bounded size. A query first searches one shard; its k-th best there
    is what all others start from. An empty side gives an empty result.

    verified_col, if given, names a new column: how many rows were verified on
    the original vectors for the query, in all shards.
    """
    picked = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    base, probes = picked(rows), picked(queries)
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-probes.count() // query_rows))
    sharded = base.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    blocked = probes.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("home", F.pmod(F.xxhash64("v", "id"), F.lit(shards)).cast("int"))

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "verified": np.zeros(0, np.int64)})]
        floors = dict(zip(b["id"], b["least"].fillna(-1.0)))
        base, probes = (_taking_part(x) for x in (a, b))
        for n in sorted(base.keys() & probes.keys()):
            (ids, vecs), (q_ids, q) = base[n], probes[n]
            least = np.array([floors[i] for i in q_ids])
            for me, (score, found, verified) in zip(q_ids, _search(vecs, ids, q, q_ids, least, k, dims, probability)):
                # the first row of a query in a shard carries its count; a shard without a better row has one without a neighbour
                more = score.size == 0
                out.append(
                    pd.DataFrame({"query_id": me, "vec_id": [-1] if more else found, "score": [np.nan] if more else score, "verified": [verified] + [0] * max(0, len(found) - 1)})
                )
        return pd.concat(out)

    def met(pairs: DataFrame) -> DataFrame:
        """What is found for (shard, block, id, v, least), in the rows of each shard."""
        copies = sharded if blocks == 1 else sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        copies = copies.withColumn("block", F.lit(0)) if blocks == 1 else copies
        schema = "query_id long, vec_id long, score double, verified long"
        return copies.groupBy("shard", "block").cogroup(pairs.groupBy("shard", "block")).applyInPandas(search, schema)

    start = blocked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("double"))
    near = met(start.select("shard", "block", "id", "v", "least"))
    if shards > 1:
        near = checkpointed(near)
        full = near.where("score is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        full = full.where(F.col("n") == k).select(F.col("query_id").alias("id"), "least")
        others = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").join(full, "id", "left")
        near = near.unionByName(met(others.select("shard", "block", "id", "v", "least")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cols = ["query_id", "rank", "vec_id", "score"]
    if verified_col:
        near = near.withColumn(verified_col, F.sum("verified").over(Window.partitionBy("query_id")))
        cols.append(verified_col)
    near = near.where("score is not null")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*cols)
