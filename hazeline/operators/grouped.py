"""Logistic regressions of all groups at once, by Newton steps.

Each step is one pass: tasks sum the gradient and the Hessian of their rows for
each group that they see, and a group's few sums, one for each task, are added
up and solved together. So the number of jobs depends on the steps alone, not on
the groups; a group of any size spreads over all tasks; and the coefficients
stay in a table. Rows are packed once into blocks of one group, so that a step
joins the state to blocks and not to rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.sources.shared import spool

#: Rows of a block, and values that a task holds back to fill its blocks.
BLOCK, WAITING = 4096, 1 << 22
_STATE = "_g long, n double, pos double, mean array<double>, dev array<double>, beta array<double>, old array<double>, loss double, done boolean"


def _blocks(rows: DataFrame) -> DataFrame:
    """_g, _n, _xs, _ys: up to BLOCK rows of a group, their values side by side as doubles."""
    kind = pa.schema([("_g", pa.int64()), ("_n", pa.int64()), ("_xs", pa.binary()), ("_ys", pa.binary())])

    def run(batches):
        waiting: dict[int, list] = {}
        values = 0

        def cut(g: int, parts: list, least: int):
            x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            at = 0
            while len(y) - at >= least:
                end = min(at + BLOCK, len(y))
                yield g, end - at, x[at:end].tobytes(), y[at:end].tobytes()
                at = end
            if at < len(y):
                waiting[g] = [(x[at:], y[at:])]

        def flushed(least: int):
            held = dict(waiting)
            waiting.clear()
            out = [r for g, parts in held.items() for r in cut(g, parts, least)]
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 16], strict=True), kind, strict=True)], schema=kind)

        for b in batches:
            if not len(b):
                continue
            g, y, x = b.column("_g").to_numpy(), b.column("_y").to_numpy(), b.column("_x")
            ends = x.offsets.to_numpy()  # groups may differ in their number of values
            flat = x.values.to_numpy(zero_copy_only=False)
            order = np.argsort(g, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(g[order]) != 0))
            for rows_of in np.split(order, starts[1:]):
                d = int(ends[rows_of[0] + 1] - ends[rows_of[0]])
                waiting.setdefault(int(g[rows_of[0]]), []).append((flat[ends[rows_of][:, None] + np.arange(d)], y[rows_of]))
            values += len(flat) + len(y)
            if values >= WAITING:
                # full blocks go; where too many groups wait for more rows, all do
                yield from flushed(BLOCK)
                values = sum(x.size + len(y) for parts in waiting.values() for x, y in parts)
                if values >= WAITING // 2:
                    yield from flushed(1)
                    values = 0
        yield from flushed(1)

    return rows.mapInArrow(run, "_g long, _n long, _xs binary, _ys binary")


def _pass(blocks: DataFrame, state: DataFrame, local, solve) -> DataFrame:
    """The next state: ``local(state of a group, x, y)`` gives an array to sum, ``solve(state, sum)`` the new state."""
    fields = [c.split()[0] for c in _STATE.split(", ")]

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        kept: dict[int, dict] = {}
        for pdf in batches:
            for i, (g, n, xs, ys) in enumerate(zip(pdf["_g"].tolist(), pdf["_n"].tolist(), pdf["_xs"], pdf["_ys"], strict=True)):
                if g not in kept:
                    kept[g] = {c: pdf[c].iloc[i] for c in fields}
                found = local(kept[g], np.frombuffer(xs).reshape(n, -1), np.frombuffer(ys))
                sums[g] = sums[g] + found if g in sums else found
        yield pd.DataFrame([(*kept[g].values(), s.tobytes()) for g, s in sums.items()], columns=[*fields, "_sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {c: pdf[c].iloc[0] for c in fields}
        total = sum(np.frombuffer(b) for b in pdf["_sums"])
        return pd.DataFrame([tuple((at | solve(at, total)).values())], columns=fields)

    live = blocks.join(state.where("not done"), "_g")
    moved = live.select("_n", "_xs", "_ys", *fields).mapInPandas(partial, _STATE + ", _sums binary").groupBy("_g").applyInPandas(added, _STATE)
    return spool(moved.unionByName(state.where("done")), "newton")


def _scaled(at: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), (x - np.asarray(at["mean"])) / np.asarray(at["dev"])], axis=1)


def _weights(at: dict, y: np.ndarray) -> np.ndarray:
    """Balanced classes: n / (2 * n of the class); 1 if a class is absent."""
    n, pos = at["n"], at["pos"]
    return np.where(y == 1, n / (2 * pos), n / (2 * (n - pos))) if 0 < pos < n else np.ones(len(y))


def fit_logistic(df: DataFrame, keys: Sequence[str], x: str = "x", label: str = "fog", c: float = 1.0, steps: int = 50, tol: float = 1e-9) -> DataFrame:
    """keys, intercept, coefficients, mean, dev, n of each group of ``keys``.

    ``x`` is an array of doubles, of one length within a group; it is scaled by
    the group's mean and population deviation (1 without spread), classes are
    balanced, and the sum of weighted losses + |coefficients|**2 / (2 c) is least.
    Rows with a null label or a null within ``x`` go; null keys make groups too.
    A group of one class has the coefficients that the penalty leaves it.
    """
    whole = F.col(label).isNotNull() & F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    used = df.where(whole)
    groups = used.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"), F.first(F.size(x)).alias("_width"))
    groups = spool(groups.withColumn("_g", F.monotonically_increasing_id()), "groups")
    named = groups.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_g")
    rows = used.join(named, [used[k].eqNullSafe(named[f"_k_{k}"]) for k in keys])
    rows = spool(_blocks(rows.select("_g", F.col(x).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"))), "blocks")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    state = groups.select("_g", "n", "pos", zeros(F.col("_width")).alias("mean"), F.array_repeat(F.lit(1.0), F.col("_width")).alias("dev"), zeros(F.col("_width") + 1).alias("beta"), zeros(F.col("_width") + 1).alias("old"), F.lit(float("inf")).alias("loss"), F.lit(False).alias("done"))

    state = _pass(rows, state, lambda at, v, y: v.sum(axis=0), lambda at, s: {"mean": s / at["n"]})
    state = _pass(rows, state, lambda at, v, y: ((v - np.asarray(at["mean"])) ** 2).sum(axis=0), lambda at, s: {"dev": np.where(s > 0, np.sqrt(s / at["n"]), 1.0)})

    def local(at: dict, v: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, w = _scaled(at, v), _weights(at, y)
        m = z @ np.asarray(at["beta"])
        q = 1 / (1 + np.exp(-m))
        return np.concatenate([[(w * (np.logaddexp(0, m) - y * m)).sum()], z.T @ (w * (q - y)), ((z * (w * q * (1 - q))[:, None]).T @ z).ravel()])

    def solve(at: dict, s: np.ndarray) -> dict:
        beta, old = np.asarray(at["beta"]), np.asarray(at["old"])
        d = len(beta)
        pull = np.append(0.0, np.full(d - 1, 1 / c))
        loss = s[0] + (pull * beta**2).sum() / 2
        if loss > at["loss"] + 1e-9 * abs(at["loss"]):  # too far: half the way back
            return {"beta": (beta + old) / 2}
        grad, hess = s[1 : d + 1] + pull * beta, s[d + 1 :].reshape(d, d) + np.diag(pull)
        hess[0, 0] += 1e-12
        new = beta - np.linalg.solve(hess, grad)
        return {"beta": new, "old": beta, "loss": loss, "done": bool(np.abs(new - beta).max() <= tol)}

    for _ in range(steps):
        state = _pass(rows, state, local, solve)
        if state.where("not done").isEmpty():
            break
    out = state.join(groups.select("_g", *keys), "_g")
    return out.select(*keys, F.col("beta")[0].alias("intercept"), F.slice("beta", 2, F.size("beta") - 1).alias("coefficients"), "mean", "dev", F.col("n").cast("long").alias("n"))


def scored(df: DataFrame, fitted: DataFrame, keys: Sequence[str], x: str = "x", name: str = "score") -> DataFrame:
    """``df`` with the probability by its group's regression; rows of groups without one go."""
    own = fitted.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "intercept", "coefficients", F.col("mean").alias("_mean"), F.col("dev").alias("_dev"))
    joined = df.join(own, [df[k].eqNullSafe(own[f"_k_{k}"]) for k in keys])
    scaled = F.zip_with(F.zip_with(F.col(x), F.col("_mean"), lambda a, b: a - b), F.col("_dev"), lambda a, b: a / b)
    margin = F.aggregate(F.zip_with(scaled, F.col("coefficients"), lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    return joined.withColumn(name, 1 / (1 + F.exp(-margin))).select(*df.columns, name)
