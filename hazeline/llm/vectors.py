"""Vector inputs: which rows take part, shards of near rows, and queries that go to the shards they can gain from.

A bounded sample is split at medians of a few random projections; every row goes
down these splits, so a shard holds near rows. Each shard's summary (a box or a
ball) tells what it can offer. A query first searches its most promising shard;
what it finds there says which other shards can still hold something better,
and only to those it is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.llm.runtime import spool

#: Rows of one shard, and queries that search a shard in one task.
SHARD_ROWS, QUERY_ROWS = 8192, 8192
#: Rows from which the splits are learned (a fixed choice by hash), and sample rows that a split's side holds at least.
SAMPLE, LEAST = 20_000, 16
#: Summaries and queries that are held against each other in one task.
SUMMARIES, ASKED = 2048, 4096
#: Projections for the splits.
AXES, SEED = 16, 20240229


def finite(vector: Column) -> Column:
    """Vectors without null, NaN or infinite components; a null vector is none."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = False, scale: float | None = None) -> DataFrame:
    """id, v (array<double>), n (a number of its own), dim of the rows that take part, written to shared storage.

    Null ids, null or empty vectors and ones with null, NaN or infinite
    components take no part, nor all-zero ones unless ``zero``. Vectors only
    meet those of their own dimension. With ``scale``, components become
    floor(scale * x).
    """
    v = table[vector_col].cast("array<double>")
    rows = table.select(table[id_col].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    return spool(rows.withColumn("n", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def directions(dim: int, axes: int = AXES) -> np.ndarray:
    """Gaussian directions, the same wherever they are asked for."""
    return np.random.default_rng(SEED).standard_normal((dim, axes))


class Splits:
    """Median splits on the widest axis of a sample; ``leaf`` sends points down them."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.value, self.child = [], [], []
        self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        here = len(self.axis)
        self.axis.append(0)
        self.value.append(0.0)
        self.child.append(None)
        if leaves > 1 and len(points) >= 2 * LEAST:
            self.axis[here] = int(np.ptp(points, axis=0).argmax())
            own = points[:, self.axis[here]]
            self.value[here] = float(np.median(own))
            left = own < self.value[here]
            if left.any() and not left.all():
                half = leaves // 2
                self.child[here] = (self._split(points[left], half), self._split(points[~left], leaves - half))
        return here

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if self.child[node] is None:
                out[own] = node
            elif len(own):
                left = points[own, self.axis[node]] < self.value[node]
                todo += [(self.child[node][0], own[left]), (self.child[node][1], own[~left])]
        return out


def sharded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shard``: near rows of one dimension, about SHARD_ROWS of them, written to shared storage.

    Leaves that hold more, as where many rows are equal, are dealt out by hash.
    """
    main = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if main is None:
        return rows.withColumn("shard", F.lit("").cast("string"))
    dim, total = main["dim"], main["count"]
    sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "n"), "n").limit(SAMPLE).select("v").toPandas()
    splits = Splits(matrix(sample["v"]) @ directions(dim), -(-total // SHARD_ROWS))

    def place(batches):
        for pdf in batches:
            leaf = np.full(len(pdf), -1)
            own = (pdf["dim"] == dim).to_numpy()
            if own.any():
                leaf[own] = splits.leaf(matrix(pdf["v"][own]) @ directions(dim))
            yield pdf.assign(leaf=leaf)

    placed = spool(rows.select("id", "n", "dim", "v").mapInPandas(place, "id long, n long, dim int, v array<double>, leaf long"), "placed")
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).alias("parts"))
    salt = F.pmod(F.xxhash64("id", "n"), F.col("parts"))
    return spool(placed.join(sizes, ["dim", "leaf"]).select("id", "n", "dim", "v", F.concat_ws(":", "dim", "leaf", salt).alias("shard")), "shards")


def reaching(queries: DataFrame, summaries: DataFrame, bound, all_better: bool) -> DataFrame:
    """n, shard, bound: of each query, the shards of its dimension that are worth a search.

    ``bound(asked, told)`` gives for each pair of a query and a summary how
    little a row there can be away (smaller is better). Of ``all_better`` shards,
    those whose bound is at most the query's ``limit``; otherwise the best one.
    Both sides meet in blocks of bounded size, one pair of blocks in a task.
    """
    shards, asked = summaries.count(), queries.count()
    parts, blocks = max(1, -(-shards // SUMMARIES)), max(1, -(-asked // ASKED))
    part = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
    left = summaries.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("n", "dim", "v", "limit", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("ask_part"), block.alias("ask_block"))
    right = right.withColumnsRenamed({"n": "ask_n", "dim": "ask_dim", "v": "ask_v", "ask_part": "part", "ask_block": "block"})

    def run(key, told: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"n": np.zeros(0, np.int64), "shard": [], "bound": np.zeros(0)})]
        for dim, own in who.groupby("ask_dim"):
            there = told[told["dim"] == dim]
            if len(there):
                away = bound(matrix(own["ask_v"]), there)
                if all_better:
                    q, s = np.nonzero(away <= own["limit"].to_numpy(float)[:, None])
                else:
                    q, s = np.arange(len(own)), away.argmin(axis=1)
                out.append(pd.DataFrame({"n": own["ask_n"].to_numpy()[q], "shard": there["shard"].to_numpy()[s], "bound": away[q, s]}))
        return pd.concat(out)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(run, "n long, shard string, bound double")


def searched(shards: DataFrame, sent: DataFrame, search, kind: str) -> DataFrame:
    """query_id, query_row, vec_id, score of ``search(rows, asked)`` in each shard; ``sent``: id, n, v, limit, shard.

    A shard that more than QUERY_ROWS queries reach is searched by several tasks.
    """
    sizes = sent.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")
    right = sent.join(sizes, "shard").select(*(F.col(c).alias(f"ask_{c}") for c in ("id", "n", "v", "limit")), "shard", block.alias("block"))
    left = shards.join(sizes, "shard").select("id", "n", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(key, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})
        return search(mine, asked.rename(columns={f"ask_{c}": c for c in ("id", "n", "v", "limit")}))

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    return found.applyInPandas(run, f"query_id long, query_row long, vec_id long, score {kind}")


def in_two_rounds(rows: DataFrame, queries: DataFrame, k: int, summary, bound, search, kind: str = "double") -> DataFrame:
    """query_id, query_row, rank, vec_id, score of the ``k`` of smallest score of each query: its most promising shard first, then all shards that can still hold better ones.

    ``summary(pdf)`` describes a shard as an array of numbers; ``search(rows,
    asked)`` honours each query's ``limit`` (the k-th score so far, or infinity).
    """
    shards = sharded(rows)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "told": [summary(matrix(pdf["v"])).tolist()]})

    summaries = spool(shards.groupBy("shard").applyInPandas(told, "shard string, dim int, told array<double>"), "summaries")
    asked = queries.select("id", "n", "dim", "v", F.lit(float("inf")).alias("limit"))
    best_of = reaching(asked, summaries, bound, False).groupBy("n").agg(F.min_by("shard", F.struct("bound", "shard")).alias("shard"))
    home = spool(asked.join(best_of, "n"), "home")
    first = spool(searched(shards, home, search, kind), "first")
    kth = best(first, k).where(F.col("rank") == k).select(F.col("query_row").alias("n"), F.col("score").cast("double").alias("kth"))
    again = spool(home.join(kth, "n", "left").withColumn("limit", F.coalesce("kth", "limit")).drop("kth").withColumnRenamed("shard", "seen"), "again")
    wider = reaching(again, summaries, bound, True).select("n", "shard")
    sent = again.join(wider, "n").where("shard <> seen").select("id", "n", "v", "limit", "shard")
    return best(first.unionByName(searched(shards, spool(sent, "sent"), search, kind)), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: the ``k`` smallest of what the shards found (at most k for each query and shard)."""
    w = W.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def places(ids: np.ndarray, names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place by id, for ties, and the place of each query's own row (-1 if it isn't here)."""
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    by_name = dict(zip(names.tolist(), place.tolist(), strict=True))
    return place, np.array([by_name.get(n, -1) for n in own.tolist()], np.int64)
