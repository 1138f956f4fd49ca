"""Cluster quality: inertia, Davies-Bouldin, silhouette, variance of feature means; k-means with restarts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.stats import percent_of_total
from hazeline.operators.sums import task_sums

#: Numbers of clusters that the elbow is sought in.
ELBOW = range(3, 21)
#: Rows that starts are drawn from.
STARTS = 4096


def _positions(df: DataFrame, vector: str, cluster: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.col(cluster).alias("c"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))


def centroids(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """c, center (array): component means of each cluster; as many rows as clusters."""
    means = _positions(df, vector, cluster).groupBy("c", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _with_centers(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    rows = df.select(F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    return rows.join(centroids(df, vector, cluster), "c").withColumn("d2", squared_distance(F.col("v"), F.col("center")))


def inertia(df: DataFrame, vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """Sum of squared distances to the own centroid."""
    return _with_centers(df, vector, cluster).agg(F.sum("d2").alias("inertia"))


def davies_bouldin(df: DataFrame, vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """Mean over clusters of the worst (spread i + spread j) / distance of centroids; pairs are of clusters only."""
    spread = _with_centers(df, vector, cluster).groupBy("c").agg(F.avg(F.sqrt("d2")).alias("s"), F.first("center").alias("center"))
    a, b = spread.alias("a"), spread.alias("b")
    pair = a.join(b, F.col("a.c") != F.col("b.c"))
    worst = pair.groupBy(F.col("a.c").alias("c")).agg(F.max((F.col("a.s") + F.col("b.s")) / F.sqrt(squared_distance(F.col("a.center"), F.col("b.center")))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def silhouette(df: DataFrame, vector: str = "embedding", cluster: str = "label", key: str = "vec_id", sample: int = 5000) -> DataFrame:
    """Mean Euclidean silhouette of at most ``sample`` rows, those of least MD5 of the key; single rows of a cluster count 0.

    The sample is the statistic's definition, so its size is bounded: blocks of
    it meet the whole sample in tasks of their own.
    """
    rows = df.select(F.col(key).alias("k"), F.col(cluster).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    chosen = rows.orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(sample)
    every = chosen.toPandas()  # at most ``sample`` vectors
    points = np.stack(every["v"].to_numpy()) if len(every) else np.zeros((0, 1))
    names, code = np.unique(every["c"].to_numpy(str), return_inverse=True) if len(every) else (np.zeros(0), np.zeros(0, int))
    sizes = np.bincount(code, minlength=len(names))
    shared = df.sparkSession.sparkContext.broadcast((points, code, sizes))

    def run(batches):
        points, code, sizes = shared.value
        member = np.zeros((len(code), len(sizes)))
        member[np.arange(len(code)), code] = 1
        for pdf in batches:
            own = pdf["i"].to_numpy()
            p = points[own]
            d = np.sqrt(np.maximum(((p[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), 0)) if len(own) * points.size < 5e7 else np.stack([np.sqrt(((points - x) ** 2).sum(axis=1)) for x in p])
            sums = d @ member
            c = code[own]
            a = sums[np.arange(len(own)), c] / np.maximum(sizes[c] - 1, 1)
            others = sums / sizes
            others[np.arange(len(own)), c] = np.inf
            b = others.min(axis=1)
            s = np.where((sizes[c] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pd.DataFrame({"s": s})

    index = df.sparkSession.range(len(every)).select(F.col("id").alias("i")).repartition(max(1, len(every) // 500))
    return index.mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


def feature_variance_pct(df: DataFrame, vector: str = "embedding", cluster: str = "label") -> DataFrame:
    """Population variance over clusters of each component's mean, in percent of the total."""
    means = _positions(df, vector, cluster).groupBy("c", "i").agg(F.avg("x").alias("m"))
    return percent_of_total(means.groupBy(F.col("i").alias("feature")).agg(F.var_pop("m").alias("variance")), "variance", name="variance_pct")


class KMeansFit:
    """Centers of one fit and its cost (sum of squared distances)."""

    def __init__(self, features: str, centers: np.ndarray, cost: float):
        self.features, self.centers, self.cost = features, centers, cost

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the number of the nearest center, the lowest of equals."""
        centers = self.centers

        @F.pandas_udf("int")
        def nearest(values: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(values.to_numpy()), centers)[0]) if len(values) else pd.Series([], dtype="int32")

        return df.withColumn(name, nearest(_array(df, self.features)))


def _array(df: DataFrame, features: str) -> Column:
    """The features as an array, if they are a vector of Spark ML or an array already."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest center."""
    d = (centers**2).sum(axis=1) - 2 * x @ centers.T
    at = d.argmin(axis=1)
    return at.astype(np.int32), np.maximum(((x - centers[at]) ** 2).sum(axis=1), 0)


def plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starts among the rows of a sample, each with a chance that grows with its squared distance to those before."""
    rnd = np.random.default_rng(seed)
    chosen = [int(rnd.integers(len(sample)))]
    d = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = d.sum()
        chosen.append(int(rnd.choice(len(sample), p=d / total)) if total > 0 else int(rnd.integers(len(sample))))
        d = np.minimum(d, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lloyd(df: DataFrame, features: str, starts: list[np.ndarray], max_iter: int = 50, tol: float = 1e-4) -> list[KMeansFit]:
    """Lloyd's iterations from each of ``starts``, all fits in one scan an iteration.

    Tasks sum the rows of each center of each fit, Spark adds the sums up, the
    driver moves the centers, which are all that it holds. A fit whose centers
    all move by at most ``tol`` is done; a center without rows stays.
    """
    rows = df.select(_array(df, features).alias("v")).where("v is not null")
    centers = [c.astype(np.float64) for c in starts]
    costs, live = [0.0] * len(centers), list(range(len(centers)))
    for step in range(max_iter + 1):
        # the last scan tells the costs of the centers as they are
        which = live if step < max_iter else list(range(len(centers)))
        found = _sums(rows, [centers[i] for i in which])
        still = []
        for i, (sums, n, cost) in zip(which, found, strict=True):
            costs[i] = cost
            if i in live and step < max_iter:
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers[i])
                moved = ((new - centers[i]) ** 2).sum(axis=1).max()
                centers[i] = new
                if moved > tol * tol:
                    still.append(i)
        if step == max_iter:
            break
        live = still
        if not live:
            costs = [cost for _, _, cost in _sums(rows, centers)]
            break
    return [KMeansFit(features, c, cost) for c, cost in zip(centers, costs, strict=True)]


def _sums(rows: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit: sums of its clusters' rows, their numbers, and the cost; one scan."""
    sizes = [c.size + len(c) + 1 for c in centers]

    def local(batches):
        out = [np.zeros(s) for s in sizes]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            for o, c in zip(out, centers, strict=True):
                at, d = _nearest(x, c)
                member = np.zeros((len(c), len(x)))
                member[at, np.arange(len(x))] = 1
                o[: c.size] += (member @ x).ravel()
                o[c.size : -1] += member.sum(axis=1)
                o[-1] += d.sum()
        return np.concatenate(out)

    every, found, begin = task_sums(rows, sum(sizes), local), [], 0
    for c, s in zip(centers, sizes, strict=True):
        part = every[begin : begin + s]
        found.append((part[: c.size].reshape(c.shape), part[c.size : -1], float(part[-1])))
        begin += s
    return found


def kmeans(df: DataFrame, features: str, k: int = 8, restarts: int = 10, seed: int = 42, max_iter: int = 50) -> tuple[KMeansFit, float]:
    """(fit, cost) of least cost over seeds seed, seed + 1, ...; the features are cached for the runs."""
    found = _least(df, features, [k], restarts, seed, max_iter)[k]
    return found, found.cost


def elbow_scan(df: DataFrame, features: str, ks=ELBOW, restarts: int = 10, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """k, inertia for each k; all fits move together."""
    found = _least(df, features, list(ks), restarts, seed, max_iter)
    return df.sparkSession.createDataFrame([(k, float(f.cost)) for k, f in found.items()], "k int, inertia double")


def _least(df: DataFrame, features: str, ks: list[int], restarts: int, seed: int, max_iter: int) -> dict[int, KMeansFit]:
    """The fit of least cost for each k. Starts are drawn by k-means++ from STARTS rows, those of least hash."""
    data = df.select(_array(df, features).alias(features)).where(F.col(features).isNotNull()).persist()
    try:
        sample = data.orderBy(F.xxhash64(features)).limit(STARTS).toPandas()[features]
        points = np.stack(sample.to_numpy()).astype(np.float64)
        jobs = [(k, seed + i) for k in ks for i in range(restarts)]
        fits = lloyd(data, features, [plus_plus(points, k, s) for k, s in jobs], max_iter)
    finally:
        data.unpersist()
    best: dict[int, KMeansFit] = {}
    for (k, _), f in zip(jobs, fits, strict=True):
        if k not in best or f.cost < best[k].cost:
            best[k] = f
    return best
