"""Sums of long arrays over tasks, for models whose steps are sums over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Values that travel in one row.
PART = 8192


def task_sums(df: DataFrame, size: int, local: Callable[[Iterator[pd.DataFrame]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of ``local(batches)``, ``size`` numbers each.

    Arrays travel in parts; rows of a part are added up as they come, so that
    no task holds more than one part, however many tasks there are. Only the
    sum reaches the driver.
    """

    def run(batches):
        every = local(batches)
        yield pd.DataFrame({"part": range(0, size, PART), "sums": [every[i : i + PART].tobytes() for i in range(0, size, PART)]})

    def added(batches):
        part, total = None, None
        for pdf in batches:
            for p, data in zip(pdf["part"].tolist(), pdf["sums"].tolist(), strict=True):
                if part is not None and p != part:
                    yield pd.DataFrame({"part": [part], "sums": [total.tobytes()]})
                    part = None
                if part is None:
                    part, total = p, np.zeros(len(data) // 8)
                total += np.frombuffer(data)
        if part is not None:
            yield pd.DataFrame({"part": [part], "sums": [total.tobytes()]})

    out = "part int, sums binary"
    tasks = max(1, min(8, size // PART))
    every = np.zeros(size)
    for r in df.mapInPandas(run, out).repartition(tasks, "part").sortWithinPartitions("part").mapInPandas(added, out).collect():
        values = np.frombuffer(r["sums"])
        every[r["part"] : r["part"] + len(values)] = values
    return every
