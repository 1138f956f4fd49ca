"""Operator 2: approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected on a few Gaussian directions (2-stable: the squared
projected distance of a pair is its squared distance times a chi-square
variable). Each shard indexes its projections in a kd-tree. A query takes the
tree's leaves by growing projected distance and verifies their rows on the
original vectors, until the chi-square test says that a row nearer than the
current k-th can hardly lie beyond the projected distance reached. The same
test on the box of a whole shard keeps queries from shards that offer nothing.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.vectors import AXES, directions, in_two_rounds, matrix, places, usable

LEAF = 128
#: Chance with which a nearer row would have been met before a query stops.
SURE = 0.93


def chi_square_below(x: float, m: int) -> float:
    """P(chi-square with an even number ``m`` of degrees of freedom <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_below(hi, m) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_below(mid, m) < p else (lo, mid)
    return hi


class KdTree:
    """Median splits on the widest direction down to leaves; boxes are tight."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.rows, self.low, self.high, self.child = [], [], [], []
        self._split(points, np.arange(len(points)), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        here = len(self.child)
        own = points[rows]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.rows.append(None)
        self.child.append(None)
        if len(rows) <= leaf:
            self.rows[here] = rows
        else:
            axis = int((self.high[here] - self.low[here]).argmax())
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            self.child[here] = (self._split(points, rows[order[:half]], leaf), self._split(points, rows[order[half:]], leaf))
        return here

    def leaves(self, q: np.ndarray):
        """(squared least distance, rows) of leaves by growing distance."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        away = (gap * gap).sum(axis=1).tolist()
        heap = [(away[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.child[node] is None:
                yield d, self.rows[node]
            else:
                for c in self.child[node]:
                    heapq.heappush(heap, (away[c], c))


def nearest(index: np.ndarray, place: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, tree: KdTree, shadow: np.ndarray, bound: float, limit: np.ndarray, tally: list[int] | None = None):
    """For each query the rows and distances of its ``k`` nearest found within ``limit``.

    ``place``: each row's place by id; ``own``: that of the query's own row,
    never a candidate; ``shadow``: projections; ``tally`` gathers how many leaves
    are visited and rows verified.
    """
    asked = queries @ directions(index.shape[1])
    for q, p, me, kth in zip(queries, asked, own, limit.tolist(), strict=True):
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        for away, leaf in tree.leaves(p):
            # beyond ``away`` a row at the k-th distance or less would be a chance of less than 1 - SURE
            if away > bound * kth * kth:
                break
            if kth < math.inf:  # the same test for each row of the leaf
                near = shadow[leaf] - p
                leaf = leaf[np.einsum("ij,ij->i", near, near) <= bound * kth * kth]
            if tally is not None:
                tally[0] += 1
                tally[1] += len(leaf)
            d = index[leaf] - q
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            fit = (d <= kth) & (place[leaf] != me)
            if fit.any():
                rows, dist = np.append(rows, leaf[fit]), np.append(dist, d[fit])
                if len(rows) > k:
                    keep = np.lexsort((place[rows], dist))[:k]
                    rows, dist = rows[keep], dist[keep]
                if len(rows) >= k:
                    kth = min(kth, dist.max())
        yield rows, dist


def box(points: np.ndarray) -> np.ndarray:
    """Least and largest projections of a shard's rows, end to end."""
    shadow = points @ directions(points.shape[1])
    return np.concatenate([shadow.min(axis=0), shadow.max(axis=0)])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``k`` rows of ``vectors`` found for each row of ``queries`` (both as ``usable`` gives them).

    A query's own row is never its neighbour, rows of equal ids are told apart
    by ``n``, ties go to smaller ids, and empty tables give an empty one.
    """
    bound = chi_square_quantile(sure, AXES)

    def away(asked: np.ndarray, told: pd.DataFrame) -> np.ndarray:
        """How near a row of each shard can be, as far as the test can tell."""
        boxes, p = matrix(told["told"]), asked @ directions(asked.shape[1])
        low, high = boxes[:, :AXES], boxes[:, AXES:]
        return np.sqrt(np.stack([(np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(axis=1) for x in p]) / bound)

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        index, q = matrix(rows["v"]), matrix(asked["v"])
        shadow = index @ directions(index.shape[1])
        ids, own = rows["id"].to_numpy(), asked["n"].to_numpy()
        place, me = places(ids, rows["n"].to_numpy(), own)
        found = [*nearest(index, place, q, me, k, KdTree(shadow), shadow, bound, asked["limit"].to_numpy(float))]
        sizes = [len(r) for r, _ in found]
        return pd.DataFrame({
            "query_id": np.repeat(asked["id"].to_numpy(), sizes), "query_row": np.repeat(own, sizes),
            "vec_id": ids[np.concatenate([r for r, _ in found])], "score": np.concatenate([d for _, d in found]),
        })

    return in_two_rounds(vectors, queries, k, box, away, run).select("query_id", "rank", "vec_id", "score")


def knn(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, by Euclidean distance; see ``vectors.usable`` for what takes part.

    Fewer than ``k`` other rows give fewer results; repeated rows are rows of
    their own; an empty table gives an empty one.
    """
    rows = usable(table, id_col, vector_col)
    return search(rows, rows.where(F.pmod("id", F.lit(every)) == 0), k)
