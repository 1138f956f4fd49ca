"""A convolutional network on windows of hourly rows, trained data-parallel.

Blocks of a convolution (kernel 3, same length), ReLU and pooling by pairs, the
last one by the largest value of all; dense layers with an L2 penalty; one
logistic output. In each step tasks compute the gradient of their rows of the
mini-batch, Spark adds the gradients up, and the driver moves the weights
(Adam), which are all that it holds. Which mini-batch a row belongs to depends
on its own hash alone, so steps come out the same for any partitioning (but for
the order of sums). Batch normalisation and dropout are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.features import last_fraction, sequences
from hazeline.operators.stats import percent_of_total
from hazeline.operators.sums import task_sums
from hazeline.operators.variants import class_weights
from hazeline.sources.shared import spool

#: Windows whose gradient is computed at a time.
BLOCK = 512


@dataclass
class ConvNet:
    """Weights of a network for windows of ``length`` rows of ``cols``; ``theta`` holds them all."""

    cols: tuple[str, ...]
    length: int
    filters: tuple[int, ...] = (64, 128, 256)
    dense: tuple[int, ...] = (128, 64)
    l2: float = 0.01
    seed: int = 42
    theta: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.shapes: list[tuple[int, ...]] = []
        width = len(self.cols)
        for f in self.filters:
            self.shapes += [(3 * width, f), (f,)]
            width = f
        for f in (*self.dense, 1):
            self.shapes += [(width, f), (f,)]
            width = f
        if self.theta is None:
            rnd = np.random.default_rng(self.seed)
            scale = [np.sqrt(6 / sum(s)) if len(s) > 1 else 0.0 for s in self.shapes]
            self.theta = np.concatenate([rnd.uniform(-a, a, s).ravel() if a else np.zeros(s) for a, s in zip(scale, self.shapes, strict=True)])

    def layers(self, theta: np.ndarray | None = None) -> list[np.ndarray]:
        theta, out, at = self.theta if theta is None else theta, [], 0
        for s in self.shapes:
            n = int(np.prod(s))
            out.append(theta[at : at + n].reshape(s))
            at += n
        return out

    def _forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        w, kept, at = self.layers(), [], 0
        for i, f in enumerate(self.filters):
            n, t, c = x.shape
            around = np.zeros((n, t + 2, c))
            around[:, 1:-1] = x
            cols = np.concatenate([around[:, :-2], around[:, 1:-1], around[:, 2:]], axis=2)
            y = np.maximum(cols @ w[at] + w[at + 1], 0.0)
            if i + 1 < len(self.filters):
                pairs = y[:, : t // 2 * 2].reshape(n, t // 2, 2, f)
                x, arg = pairs.max(axis=2), pairs.argmax(axis=2)
            else:
                x, arg = y.max(axis=1), y.argmax(axis=1)
            if keep:
                kept.append((cols, y, arg))
            at += 2
        for i in range(len(self.dense) + 1):
            z = x @ w[at] + w[at + 1]
            if keep:
                kept.append((x, z))
            x = np.maximum(z, 0.0) if i < len(self.dense) else z
            at += 2
        return x[:, 0], kept

    def probability(self, x: np.ndarray) -> np.ndarray:
        """``x``: windows, rows, columns."""
        return 1 / (1 + np.exp(-self._forward(x)[0]))

    def losses(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = self._forward(x)[0]
        return np.logaddexp(0, z) - y * z

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """(sum of weighted losses, its gradient by ``theta``), without the penalty."""
        z, kept = self._forward(x, keep=True)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        w, grads = self.layers(), [None] * len(self.shapes)
        back = (weight * (1 / (1 + np.exp(-z)) - y))[:, None]
        at = len(self.shapes) - 2
        for i in reversed(range(len(self.dense) + 1)):
            before, out = kept[len(self.filters) + i]
            if i < len(self.dense):
                back = back * (out > 0)
            grads[at], grads[at + 1] = before.T @ back, back.sum(axis=0)
            back = back @ w[at].T
            at -= 2
        for i in reversed(range(len(self.filters))):
            cols, y_, arg = kept[i]
            n, t, f = y_.shape
            full = np.zeros_like(y_)
            if i + 1 < len(self.filters):
                pairs = full[:, : t // 2 * 2].reshape(n, t // 2, 2, f)
                np.put_along_axis(pairs, arg[:, :, None, :], back[:, :, None, :], axis=2)
                full[:, : t // 2 * 2] = pairs.reshape(n, t // 2 * 2, f)
            else:
                np.put_along_axis(full, arg[:, None, :], back[:, None, :], axis=1)
            full *= y_ > 0
            grads[at] = np.tensordot(cols, full, axes=([0, 1], [0, 1]))
            grads[at + 1] = full.sum(axis=(0, 1))
            wide = full @ w[at].T
            c = wide.shape[2] // 3
            around = np.zeros((n, t + 2, c))
            for k in range(3):
                around[:, k : k + t] += wide[:, :, k * c : (k + 1) * c]
            back = around[:, 1:-1]
            at -= 2
        return loss, np.concatenate([g.ravel() for g in grads])

    def penalty(self) -> tuple[float, np.ndarray]:
        """(L2 penalty of the dense layers but the last, its gradient)."""
        first = 2 * len(self.filters)
        penalised = {first + 2 * i for i in range(len(self.dense))}
        grads = [2 * self.l2 * w if i in penalised else np.zeros_like(w) for i, w in enumerate(self.layers())]
        return self.l2 * sum(float((w**2).sum()) for i, w in enumerate(self.layers()) if i in penalised), np.concatenate([g.ravel() for g in grads])

    def importance(self, spark) -> DataFrame:
        """feature, importance, importance_pct: mean |weight| of the first kernel over places and filters."""
        kernel = np.abs(self.layers()[0].reshape(3, len(self.cols), -1)).mean(axis=(0, 2))
        table = spark.createDataFrame([(c, float(v)) for c, v in zip(self.cols, kernel, strict=True)], "feature string, importance double")
        return percent_of_total(table, "importance", name="importance_pct")


def windows(df: DataFrame, cols: Sequence[str], length: int = 24, by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """``values``: the ``length`` rows before each row, one after another; rows without a full window go."""
    s = sequences(df, cols, length, by, time)
    return s.withColumn("values", F.flatten(F.transform("sequence", lambda x: F.array(*(x[c].cast("double") for c in cols))))).drop("sequence", "rn")


def _blocks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    for pdf in batches:
        for at in range(0, len(pdf), BLOCK):
            part = pdf.iloc[at : at + BLOCK]
            yield np.stack(part["values"].to_numpy()).astype(np.float64).reshape(len(part), length, -1), part


def step_sums(rows: DataFrame, net: ConvNet, batch: int, check: bool) -> tuple[dict[str, float], np.ndarray]:
    """Sums over the rows of a mini-batch: losses, weights, gradient; with ``check``, those of the validation rows' losses as well.

    ``rows``: values, label, weight, batch (-1 of validation rows).
    """
    size = len(net.theta)

    def local(batches):
        told, grad = np.zeros(4), np.zeros(size)
        for x, part in _blocks(batches, net.length):
            y, weight, which = (part[c].to_numpy(np.float64) for c in ("label", "weight", "batch"))
            mine = which == batch
            if mine.any():
                loss, g = net.gradient(x[mine], y[mine], weight[mine])
                grad += g
                told[:2] += loss, mine.sum()
            held = which < 0
            if held.any():
                told[2:] += net.losses(x[held], y[held]).sum(), held.sum()
        return np.concatenate([told, grad])

    seen = rows.where((F.col("batch") == batch) | (F.col("batch") < 0)) if check else rows.where(F.col("batch") == batch)
    every = task_sums(seen.select("values", "label", "weight", "batch"), size + 4, local)
    return dict(zip(("loss", "n", "check_loss", "check_n"), every[:4].tolist(), strict=True)), every[4:]


@dataclass
class Adam:
    rate: float = 0.001
    decay: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    mean: np.ndarray | float = 0.0
    square: np.ndarray | float = 0.0

    def moved(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.steps += 1
        a, b = self.decay
        self.mean = a * self.mean + (1 - a) * grad
        self.square = b * self.square + (1 - b) * grad**2
        return theta - self.rate * (self.mean / (1 - a**self.steps)) / (np.sqrt(self.square / (1 - b**self.steps)) + 1e-7)


def fit(
    seen: DataFrame, cols: Sequence[str], label: str = "fog", length: int = 24, by: Sequence[str] = ("location",), time: str = "time", epochs: int = 50, patience: int = 10, batches: int = 4,
    fraction: float = 0.2, rate: float = 0.001, **shape,
) -> ConvNet:
    """A network for ``windows`` output ``seen``: balanced classes, the last ``fraction`` of each series for validation.

    Training ends once the validation loss (unweighted, with the penalty) has
    not fallen for ``patience`` epochs, and the best weights are kept. Without
    validation rows all epochs run. No rows at all give the initial weights.
    """
    spark = seen.sparkSession
    marked = class_weights(last_fraction(seen, fraction, by, time), label)
    mine = F.pmod(F.xxhash64(*by, time, "values"), F.lit(batches)).cast("int")
    rows = marked.select("values", F.col(label).cast("double").alias("label"), "weight", F.when(F.col("is_validation"), F.lit(-1)).otherwise(mine).alias("batch"))
    rows = spool(rows, "windows").repartition(spark.sparkContext.defaultParallelism).persist()
    net, adam, best, since = ConvNet(tuple(cols), length, **shape), Adam(rate), None, 0
    try:
        for epoch in range(epochs + 1):
            for batch in range(batches if epoch < epochs else 1):
                told, grad = step_sums(rows, net, batch, check=batch == 0)
                if batch == 0 and told["check_n"]:  # the weights that the last epoch ended with
                    loss = told["check_loss"] / told["check_n"] + net.penalty()[0]
                    best, since = ((loss, net.theta.copy()), 0) if best is None or loss < best[0] else (best, since + 1)
                    if since >= patience:
                        return ConvNet(net.cols, length, theta=best[1], **shape)
                if told["n"] and epoch < epochs:
                    net.theta = adam.moved(net.theta, grad / told["n"] + net.penalty()[1])
    finally:
        rows.unpersist()
    return ConvNet(net.cols, length, theta=best[1], **shape) if best else net


def scored(net: ConvNet, seen: DataFrame, name: str = "score") -> DataFrame:
    """``windows`` output with the network's probability instead of ``values``."""

    @F.pandas_udf("double")
    def probability(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values))
        for at in range(0, len(values), BLOCK):
            part = values.iloc[at : at + BLOCK]
            out[at : at + BLOCK] = net.probability(np.stack(part.to_numpy()).astype(np.float64).reshape(len(part), net.length, -1))
        return pd.Series(out)

    return seen.withColumn(name, probability("values")).drop("values")
