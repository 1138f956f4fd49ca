"""Random forests of two classes on counts of rows that Spark adds up.

Trees see nothing of a row but the bins of its features and its label, so rows
of the same bins and label become one cell with their number. A bootstrap
sample takes each row a number of times that is Poisson of mean 1; a cell of n
rows is then taken Poisson of mean n times, and is drawn so, once for each
tree. Rows are read twice, for the bins and for the cells; for each level of
all trees together, tasks count cells by (node, feature, bin, label), Spark
adds these counts, and the driver, which holds nothing but counts and trees,
chooses the splits. As counts are whole numbers and draws hang on the cell
alone, a forest doesn't depend on how rows are dealt over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.boosting import Tree, _cut, _mixed, binned
from hazeline.operators.stats import percent_of_total
from hazeline.sources.shared import spool

#: Quantiles of a class that the cuts of a feature are chosen from.
POINTS = 2000
#: Counts that one pass over the cells makes; the nodes of a level take several passes beyond.
COUNTS = 1 << 21
#: Cells of up to so many rows are drawn together, larger ones each by a generator of its own for all trees.
SMALL = 16


@dataclass
class Forest:
    """Trees whose values are the weighted share of positives, and whose gains are those of the weighted rows of a node."""

    cols: tuple[str, ...]
    edges: list[np.ndarray]
    trees: list[Tree]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.edges)

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return sum((np.array(t.value)[t.nodes(bins)] for t in self.trees), np.zeros(len(bins))) / max(1, len(self.trees))

    def importance(self, spark) -> DataFrame:
        """feature, importance, importance_pct: a feature's share of each tree's gains, averaged over trees."""
        shares = np.zeros(len(self.cols))
        for t in self.trees:
            own = np.zeros(len(self.cols))
            inner = np.array(t.feature) >= 0
            np.add.at(own, np.array(t.feature)[inner], np.array(t.gain)[inner])
            shares += own / own.sum() if own.sum() > 0 else 0
        table = spark.createDataFrame([(c, float(v)) for c, v in zip(self.cols, shares / (shares.sum() or 1), strict=True)], "feature string, importance double")
        return percent_of_total(table, "importance", name="importance_pct")


def cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts, halfway between neighbours: all of few values, else those nearest to equal weights."""
    values, at = np.unique(values, return_inverse=True)
    weights = np.bincount(at, weights, len(values))
    halfway = values[:-1] / 2 + values[1:] / 2
    if len(halfway) < bins:
        return halfway
    found, upto = [], np.cumsum(weights)
    target = stride = upto[-1] / bins
    for k in range(1, len(values)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append(halfway[k - 1])
            target += stride
    return np.array(found)


def poisson(means: np.ndarray, keys: np.ndarray, seeds: Sequence[int]) -> np.ndarray:
    """For each seed a Poisson number of each mean (a whole number of at least 1), which hangs on the key and the seeds only."""
    out = np.zeros((len(seeds), len(means)), np.int64)
    for mean in range(1, SMALL + 1):
        own = np.flatnonzero(means == mean)
        if len(own):
            below = np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(12 * mean + 20)])
            for k, seed in enumerate(seeds):
                out[k, own] = np.searchsorted(below, _mixed(keys[own], seed), "right")
    for k in np.flatnonzero(means > SMALL):
        own = np.random.Generator(np.random.Philox(key=[int(keys[k]) & (1 << 64) - 1, seeds[0] & (1 << 64) - 1]))
        out[:, k] = own.poisson(means[k], len(seeds))
    return out


def fit(
    train: DataFrame, cols: Sequence[str], label: str = "fog", trees: int = 20, depth: int = 10, leaf: int = 25, bins: int = 32, tried: int | None = None, bootstrap: bool = True, seed: int = 42,
) -> Forest:
    """A forest by Gini impurity for ``label``; both classes weigh the same.

    Each node tries ``tried`` features (None: the square root of their number,
    rounded up), a side of a split has at least ``leaf`` rows of the sample, and
    leaves side by side that decide alike become one. Rows with a null or NaN
    feature or a null label go; without positives every probability is 0.
    """
    spark, names = train.sparkSession, list(cols)
    data = train.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in names), F.col(label).cast("int").alias("_y"))
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    points = F.array(*(F.lit(k / POINTS) for k in range(POINTS + 1)))
    own = [F.percentile_approx(F.when(whole, F.col(c)), points, F.lit(10 * POINTS)).alias(c) for c in names]
    told = {r["_y"]: r for r in data.groupBy("_y").agg(F.count("*").alias("_n"), *own).collect()}  # two rows of at most POINTS values a feature
    n, pos = sum(r["_n"] for r in told.values()), told[1]["_n"] if 1 in told else 0
    weight = np.array([n / (2 * (n - pos)), n / (2 * pos)]) if 0 < pos < n else np.ones(2)
    edges = []
    for c in names:
        seen = [(r[c], weight[y] * r["_n"] / len(r[c])) for y, r in told.items() if r[c]]
        values, shares = (np.concatenate(x) for x in ([np.array(v) for v, _ in seen] or [np.zeros(0)], [np.full(len(v), w) for v, w in seen] or [np.zeros(0)]))
        edges.append(cuts(values, shares, bins))
    model = Forest(tuple(names), edges, [])
    seeds = [seed * 1_000_003 + t for t in range(trees)]
    cells = spool(_cells(data.where(whole), model, seeds, bootstrap), "forest")
    return _grown(cells, model, trees, depth, leaf, weight, tried or math.ceil(math.sqrt(len(names))), np.random.default_rng(seed))


def _cells(data: DataFrame, model: Forest, seeds: Sequence[int], bootstrap: bool) -> DataFrame:
    """bins (two bytes a feature), y, n and u0, u1, ...: how often each tree's sample takes rows of the cell."""
    width = 2 * len(model.cols)
    rows_kind = pa.schema([("bins", pa.binary()), ("y", pa.int32())])

    def run(batches):
        for b in batches:
            values = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in model.cols], axis=1)
            bins = np.ascontiguousarray(model.bins(values).astype("<u2"))
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.arange(len(b) + 1, dtype="<i4") * np.int32(width)), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([packed, b.column("_y")], schema=rows_kind)

    kind = pa.schema([("bins", pa.binary()), ("y", pa.int32()), ("n", pa.int64()), *((f"u{t}", pa.int64()) for t in range(len(seeds)))])

    def drawn(batches):
        for b in batches:
            n, keys = b.column("n").to_numpy(), b.column("key").to_numpy()
            taken = poisson(n, keys, seeds) if bootstrap else [n] * len(seeds)
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("y"), b.column("n"), *map(pa.array, taken)], schema=kind)

    counted = data.mapInArrow(run, "bins binary, y int").groupBy("bins", "y").agg(F.count("*").alias("n"))
    return counted.withColumn("key", F.xxhash64("bins", "y")).mapInArrow(drawn, "bins binary, y int, n long, " + ", ".join(f"u{t} long" for t in range(len(seeds))))


def _counts(cells: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]], features: np.ndarray, width: int) -> np.ndarray:
    """Rows of each node (tree, number; in order of trees) by the features it tries, bin (from 1) and label."""
    tried = features.shape[1]
    each = tried * width * 2
    spans = {}
    for k, (t, _) in enumerate(nodes):
        spans[t] = spans.get(t, (k, 0))[0], k + 1
    kind = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(batches):
        found = np.zeros(len(nodes) * each)
        for b in batches:
            if not len(b):
                continue
            every, label = _cut(b.column("bins")), b.column("y").to_numpy()
            for t, (first, last) in spans.items():
                place = np.full(len(trees[t].value), -1)
                place[[n for _, n in nodes[first:last]]] = np.arange(last - first)
                taken = b.column(f"u{t}").to_numpy()
                at = place[trees[t].nodes(every)]
                live = np.flatnonzero((at >= 0) & (taken > 0))
                at = at[live]
                own = np.take_along_axis(every[live], features[first:last][at], axis=1) - 1
                slot = ((at[:, None] * tried + np.arange(tried)) * width + own) * 2 + label[live, None]
                found[first * each : last * each] += np.bincount(slot.ravel(), np.repeat(taken[live], tried), (last - first) * each)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some].astype(np.int64))], schema=kind)

    told = cells.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most COUNTS, or those of one node
    out = np.zeros(len(nodes) * each)
    out[told["slot"].to_numpy(np.int64)] = told["n"].to_numpy()
    return out.reshape(len(nodes), tried, width, 2)


def _splits(counts: np.ndarray, weight: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """Of each node: gain (-inf without a split), place of its feature, last bin on the left, counts of the left side; the first of equals."""
    left = counts.cumsum(axis=2)[:, :, :-1]
    right = counts.sum(axis=2, keepdims=True) - left

    def gini(c):
        w = c * weight
        total = w.sum(axis=-1)
        return 1 - ((w / np.maximum(total, 1e-300)[..., None]) ** 2).sum(axis=-1), total

    (a, wa), (b, wb), (whole, all_) = gini(left), gini(right), gini(counts.sum(axis=2))
    part = wa / np.maximum(all_, 1e-300)[..., None]
    gain = whole[..., None] - part * a - wb / np.maximum(all_, 1e-300)[..., None] * b
    gain = np.where((left.sum(axis=-1) >= leaf) & (right.sum(axis=-1) >= leaf), gain, -np.inf)
    if not gain.shape[2]:
        return np.full(len(counts), -np.inf), *(np.zeros(len(counts), np.int64),) * 2, np.zeros((len(counts), 2))
    best = gain.reshape(len(counts), -1).argmax(axis=1)
    at, k = np.divmod(best, gain.shape[2])
    rows = np.arange(len(counts))
    return gain[rows, at, k], at, k + 1, left[rows, at, k]


def _grown(cells: DataFrame, model: Forest, trees: int, depth: int, leaf: int, weight: np.ndarray, tried: int, rnd: np.random.Generator) -> Forest:
    names, width = model.cols, max((len(e) for e in model.edges), default=0) + 1
    tried = min(tried, len(names))

    def share(c):
        return float(c[1] * weight[1] / max((c * weight).sum(), 1e-300))

    model.trees = [Tree() for _ in range(trees)]
    for t in model.trees:
        t.add(0.0)
    open_ = [(t, 0) for t in range(trees)]
    for level in range(depth if tried else 0):
        # drawn before the passes, so that their number changes nothing
        features = np.sort(np.stack([rnd.permutation(len(names))[:tried] for _ in open_]), axis=1)
        size, coming = max(1, COUNTS // (tried * width * 2)), []
        for k in range(0, len(open_), size):
            nodes, own = open_[k : k + size], features[k : k + size]
            counts = _counts(cells, model.trees, nodes, own, width)
            whole = counts[:, 0].sum(axis=1)
            for (t, node), f, total, gain, at, cut, left in zip(nodes, own, whole, *_splits(counts, weight, leaf), strict=True):
                tree = model.trees[t]
                if level == 0:
                    tree.value[node] = share(total)
                if gain > 0:
                    tree.feature[node], tree.bin[node], tree.gain[node] = int(f[at]), int(cut), float(gain * (total * weight).sum())
                    sides = [tree.add(share(c)) for c in (left, total - left)]
                    tree.left[node], tree.right[node] = sides
                    coming += [(t, s, c) for s, c in zip(sides, (left, total - left), strict=True) if c.sum() >= 2 * leaf and c.min() > 0]
        open_ = [(t, s) for t, s, _ in coming]
        if not open_:
            break
    for t in model.trees:
        for k in reversed(range(len(t.value))):  # children come after their parent
            if t.feature[k] >= 0:
                a, b = t.left[k], t.right[k]
                if t.feature[a] < 0 and t.feature[b] < 0 and (t.value[a] > 0.5) == (t.value[b] > 0.5):
                    t.feature[k], t.gain[k] = -1, 0.0
    return model


def scored(model: Forest, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the forest's probability."""

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        return pd.Series(model.probability(model.bins(values)))

    return df.withColumn(name, probability(*(F.col(c).cast("double") for c in model.cols)))
