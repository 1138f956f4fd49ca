"""Operator 5: exact top-k by inner product, with ball trees and branch and bound.

Each shard keeps its vectors in a ball tree. Queries go down the tree in
blocks: each takes the child of higher bound (its product with the center plus
its length times the radius) first, and leaves a node whose bound is under its
current k-th score. A query first searches the shard of highest bound; the k-th
score found there goes with it to all other shards whose bound reaches it, and
no others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.vectors import in_two_rounds, matrix, places, usable

LEAF = 256
#: Largest component for which products of up to 2**11 components are exact as doubles.
EXACT = 1 << 20


class BallTree:
    """Splits by the farthest pair's direction; node: center, radius, rows (leaves) or children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.center, self.radius, self.rows, self.child = [], [], [], []
        self._split(points.astype(np.float64), np.arange(len(points)), leaf)
        self.center, self.radius = np.array(self.center), np.array(self.radius)

    def _split(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        here = len(self.child)
        own = points[rows]
        center = own.mean(axis=0)
        away = np.linalg.norm(own - center, axis=1)
        self.center.append(center)
        self.radius.append(away.max() * (1 + 1e-9) + 1e-6)  # no rounding may lose a row
        self.rows.append(None)
        self.child.append(None)
        if len(rows) <= leaf:
            self.rows[here] = rows
        else:
            a = own[away.argmax()]
            b = own[np.linalg.norm(own - a, axis=1).argmax()]
            order = np.argsort(own @ (b - a), kind="stable")
            half = len(rows) // 2
            self.child[here] = (self._split(points, rows[order[:half]], leaf), self._split(points, rows[order[half:]], leaf))
        return here


class Search:
    """Top ``k`` of each query over one tree; ``floor``: scores that k rows elsewhere reach already."""

    def __init__(self, tree: BallTree, points: np.ndarray, order: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        self.tree, self.points, self.order, self.queries, self.own, self.k = tree, points, order, queries, own, k
        self.length = np.linalg.norm(queries.astype(np.float64), axis=1)
        self.bounds = queries.astype(np.float64) @ tree.center.T + self.length[:, None] * tree.radius[None, :]
        self.bounds += np.abs(self.bounds) * 1e-9 + 1e-6
        self.floor = floor.astype(np.float64)
        self.none = np.iinfo(np.int64).min
        self.score = np.full((len(queries), k), self.none)
        self.row = np.full((len(queries), k), -1)
        self.visit(0, np.arange(len(queries)))

    def visit(self, node: int, who: np.ndarray) -> None:
        who = who[self.bounds[who, node] >= self.floor[who]]
        if not len(who):
            return
        if self.tree.child[node] is None:
            self.leaf(self.tree.rows[node], who)
            return
        a, b = self.tree.child[node]
        left = self.bounds[who, a] >= self.bounds[who, b]
        self.visit(a, who[left])
        self.visit(b, who)
        self.visit(a, who[~left])

    def leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        got = self.queries[who] @ self.points[rows].T
        got = got if got.dtype == np.int64 else np.rint(got).astype(np.int64)
        got[self.own[who][:, None] == self.order[rows][None, :]] = self.none
        score = np.concatenate([self.score[who], got], axis=1)
        row = np.concatenate([self.row[who], np.broadcast_to(rows, got.shape)], axis=1)
        # score first, then the smaller id
        ties = np.where(row >= 0, self.order[row], np.iinfo(np.int64).max)
        keep = np.lexsort((ties, -score.astype(np.float64) if self.points.dtype != np.int64 else ~score), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(score, keep, axis=1)
        self.row[who] = np.take_along_axis(row, keep, axis=1)
        self.floor[who] = np.maximum(self.floor[who], self.score[who, self.k - 1])


def ball(points: np.ndarray) -> np.ndarray:
    """Center and radius of a shard's rows, end to end."""
    center = points.mean(axis=0)
    return np.append(center, np.linalg.norm(points - center, axis=1).max() * (1 + 1e-9) + 1e-6)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score (long): the ``k`` largest inner products, ties to smaller ids; both: ``vectors.usable`` of whole numbers."""

    def under(asked: np.ndarray, told: pd.DataFrame) -> np.ndarray:
        """The negative of the most that a product with a row of each shard can be."""
        balls = matrix(told["told"])
        most = asked @ balls[:, :-1].T + np.linalg.norm(asked, axis=1)[:, None] * balls[None, :, -1]
        return -(most + np.abs(most) * 1e-9 + 1e-6)

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        points, q = matrix(rows["v"]), matrix(asked["v"])
        if max(np.abs(points).max(), np.abs(q).max()) > EXACT or points.shape[1] > 1 << 11:
            points, q = points.astype(np.int64), q.astype(np.int64)
        ids, own = rows["id"].to_numpy(np.int64), asked["n"].to_numpy()
        place, me = places(ids, rows["n"].to_numpy(), own)
        found = Search(BallTree(points), points, place, q, me, k, -asked["limit"].to_numpy(float))
        who, nth = np.nonzero(found.score > found.none)
        return pd.DataFrame({"query_id": asked["id"].to_numpy(np.int64)[who], "query_row": own[who], "vec_id": ids[found.row[who, nth]], "score": -found.score[who, nth]})

    # scores are negated between the rounds, so that smaller is better for both operators
    found = in_two_rounds(vectors, queries, k, ball, under, run, "long")
    return found.select("query_id", "rank", "vec_id", (-F.col("score")).alias("score"))


def top_products(table: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` largest integer products of each row whose id is divisible by ``every``, components as floor(scale * x).

    Rows that ``vectors.usable`` leaves out take no part, but all-zero vectors
    do. Fewer than ``k`` other rows give fewer results; repeated rows are rows of
    their own; an empty table gives an empty one. Components must stay within
    2**53 and scores within 64 bits.
    """
    rows = usable(table, id_col, vector_col, zero=True, scale=scale)
    return search(rows, rows.where(F.pmod("id", F.lit(every)) == 0), k)
