"""Lags and night lows of series that arrive as a stream, row by row in order of time once the watermark has passed them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

#: Rows that a task holds before it adds them to the days in its state.
HELD = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Series(StatefulProcessor):
    """A location's rows wait by day until they are due: those of 0-5 h at 6 h, when the night is over, all others at their time.

    State: the days that wait, each with its rows, and what later rows need of
    the earlier ones (as many values as the longest lag, the low of the day, the
    evening so far). A task holds one day of one location at a time.
    """

    def __init__(self, hours: Sequence[int], names: Sequence[str]):
        self.hours, self.names = list(hours), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "hour array<int>, at array<bigint>, due array<bigint>, temp array<double>")
        self.past = handle.getValueState("past", "temps array<double>, day int, evening double, low double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, held, n = math.inf, {}, 0
        for r in rows:
            first = min(first, r["_due"])
            held.setdefault(r["_day"], []).append((r["_hour"], r["_at"], r["_due"], r["_temp"]))
            n += 1
            if n % HELD == 0:
                self.keep(held)
                held = {}
        self.keep(held)
        self.wake(first)
        yield from ()

    def keep(self, held: dict[int, list[tuple]]) -> None:
        for day, rows in held.items():
            if self.days.containsKey((day,)):
                rows = [*zip(*self.days.getValue((day,)), strict=True), *rows]
            self.days.updateValue((day,), tuple(list(c) for c in zip(*rows, strict=True)))

    def wake(self, due: float) -> None:
        """A timer for the first row that waits, unless an earlier one is set."""
        if due < math.inf:
            at = -(-int(due) // 1000)
            timers = list(self.handle.listTimers())
            if not any(t <= at for t in timers):
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        temps, last, evening, low = self.past.get() if self.past.exists() else ([], None, None, None)
        temps, first = list(temps), math.inf
        for day in sorted(k[0] for k in self.days.keys()):
            rows = sorted(zip(*self.days.getValue((day,)), strict=True), key=lambda r: (r[1], r[3] is not None, order(r[3])))
            due = [r for r in rows if r[2] <= passed]
            if due and day != last:
                morning = least(*(temp for hour, _, _, temp in due if hour < 6))
                low = None if last is None else least(evening, morning)
                last, evening = day, None
            for hour, at, _, temp in due:
                rates = [None if len(temps) < h or temp is None or temps[-h] is None else (temp - temps[-h]) / h for h in self.hours]
                yield Row(*self.names)(*key, at, temp, *rates, low)
                temps = [*temps, temp][-max(self.hours) :]
                if hour >= 18:
                    evening = least(evening, temp)
            left = rows[len(due) :]
            if not left:
                self.days.removeKey((day,))
                continue
            first = min(first, left[0][2])
            if due:
                self.days.updateValue((day,), tuple(list(c) for c in zip(*left, strict=True)))
            break  # days after one that waits wait as well
        if last is not None:
            self.past.update((temps, last, evening, low))
        if first < math.inf:
            self.handle.registerTimer(max(-(-first // 1000), passed // 1000 + 1))

    def close(self) -> None:
        pass


def order(x: float | None) -> tuple[bool, float]:
    """Numbers as Spark orders them: NaN last."""
    return (x is not None and math.isnan(x), 0.0 if x is None or math.isnan(x) else x)


def least(*xs: float | None) -> float | None:
    return min((x for x in xs if x is not None), key=order, default=None)


def lagged(stream: DataFrame, hours: Sequence[int] = (6, 12), temp: str = "temp", by: str = "location", time: str = "time", lateness: str = "2 hours") -> DataFrame:
    """``by``, time, temp, cooling_rate_<h>h and previous_night_low of each row of a stream, as the features of the whole series have them.

    A row comes out once, when no earlier row (nor any of its night) can come
    in. Rows later than ``lateness`` and rows without a time are dropped; rows of
    the same time go by their value, nulls first. Days and hours are those of the
    session's time zone. Start it within ``rocksdb``.
    """
    at = F.col(time).cast("timestamp")
    morning = F.date_trunc("day", "time") + F.expr("interval 6 hours")
    timed = stream.select(F.col(by), at.alias("time"), F.col(temp).cast("double").alias("_temp")).where(F.col("time").isNotNull()).withWatermark("time", lateness)
    rows = timed.withColumns({
        "_day": F.unix_date(F.to_date("time")), "_hour": F.hour("time"), "_at": F.unix_micros("time"),
        "_due": F.unix_micros(F.when(F.hour("time") < 6, morning).otherwise(F.col("time"))),
    })
    out = StructType([stream.schema[by]]).add("_at", LongType()).add("temp", "double")
    for name in [*(f"cooling_rate_{h}h" for h in hours), "previous_night_low"]:
        out = out.add(name, "double")
    found = rows.groupBy(by).transformWithState(Series(hours, out.names), out, "Append", "EventTime")
    return found.select(by, F.timestamp_micros("_at").alias("time"), *out.names[2:])


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start in this block keep their state in RocksDB, which keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start(stream: DataFrame, path: str, checkpoint: str, **more):
    """Write the rows of ``lagged`` as Parquet, each once."""
    with rocksdb(stream.sparkSession):
        out = lagged(stream, **more).writeStream.outputMode("append").format("parquet")
        return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
