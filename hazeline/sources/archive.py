"""Hourly archive answers (JSON with one array for each variable) as rows, and an HTTP source for them.

``hourly_rows`` works on any column of answers, so tests and backfills read
files; the data source fetches each (location, year) by HTTP, only those that a
filter on location or time lets through. Read as a stream, it goes on where a
stopped query was, without asking again for what has been answered.
"""

from __future__ import annotations

import json
import logging
import time as clock
import urllib.parse
import urllib.request
from collections.abc import Iterable, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
)
from pyspark.sql.pandas.types import to_arrow_schema

from hazeline.sources.shared import Folder

TIMEOUT_S, PAUSE_S = 120, 4


def hourly_rows(answers: DataFrame, variables: Sequence[str], body: str = "body", keep: Sequence[str] = ("location",)) -> DataFrame:
    """One row an hour; variables that an answer lacks are null, answers without times give no rows."""
    kind = "struct<hourly: struct<time: array<string>, " + ", ".join(f"`{v}`: array<double>" for v in variables) + ">>"
    parsed = answers.select(*keep, F.from_json(F.col(body), kind).alias("_a"))
    h = F.col("_a.hourly")
    none = F.array().cast("array<double>")
    zipped = F.arrays_zip(h["time"].alias("time"), *(F.coalesce(h[v], none).alias(v) for v in variables))
    rows = parsed.select(*keep, F.explode(zipped).alias("_r")).where(F.col("_r.time").isNotNull())
    return rows.select(*keep, _time(F.col("_r.time")).alias("time"), *(F.col(f"_r.{v}").alias(v) for v in variables))


def _time(text: Column) -> Column:
    return F.to_timestamp_ntz(F.replace(text, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))


class YearsPart(InputPartition):
    """The (place, year) requests that one task makes, one after another."""

    def __init__(self, requests: list[tuple[str, str, str, int]]):
        super().__init__([f"{place}/{year}" for place, _, _, year in requests])
        self.requests = requests


class ArchiveReader(DataSourceReader):
    """Options: url, places ("name:lat:lon;..."), years ("1980-2025"), zone, pause, tasks, on_error.

    ``pause`` seconds pass between requests of the whole job: with ``tasks``
    parallel tasks, 1 by default, each waits that many times as long. A year
    that can't be had or read fails the job if ``on_error`` is "fail"; by
    default it is skipped with a warning in the task's log, and if the schema has
    a text column ``error``, with a row that holds the place, the year's first
    hour and what went wrong. A request that fails is made ``retries`` times
    more, none by default. With ``pushdown`` "true", places and years that
    filters on location and time rule out are never asked for.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.variables = [f.name for f in schema.fields if f.name not in ("location", "time", "error")]
        self.places: set[str] | None = None
        self.least, self.most = float("-inf"), float("inf")
        self.options = dict(options)
        self.tasks = int(self.options.get("tasks", 1))

    def requests(self) -> list[tuple[str, str, str, int]]:
        """(place, latitude, longitude, year) of all answers that are wanted, by place."""
        first, _, last = self.options["years"].partition("-")
        places = [p.split(":") for p in self.options["places"].split(";")]
        years = [y for y in range(int(first), int(last or first) + 1) if self.least <= y <= self.most]
        return [(*p, year) for p in places if self.places is None or p[0] in self.places for year in years]

    def partitions(self) -> list[YearsPart]:
        every = self.requests()
        return [YearsPart(every[i :: self.tasks]) for i in range(min(self.tasks, len(every)))] or [YearsPart([])]

    def read(self, part: YearsPart):
        for place, latitude, longitude, year in part.requests:
            yield self.batch(place, *self.ask(place, latitude, longitude, year))

    def ask(self, place: str, latitude: str, longitude: str, year: int) -> tuple[dict, str | None]:
        """The hours of a year, or what to show in their place and what went wrong."""
        for left in reversed(range(1 + int(self.options.get("retries", 0)))):
            try:
                hourly = self.fetch(latitude, longitude, year)
                self.batch(place, hourly)
                return hourly, None
            except (OSError, ValueError, TypeError, AttributeError) as e:  # no answer, or none in the form agreed
                if left:
                    continue
                if self.options.get("on_error", "skip") == "fail":
                    raise
                logging.getLogger(__name__).warning("%s in %d is skipped: %s", place, year, e)
                return {"time": [f"{year}-01-01T00:00"]} if "error" in self.schema.names else {}, f"{type(e).__name__}: {e}"
            finally:
                clock.sleep(float(self.options.get("pause", PAUSE_S)) * self.tasks)
        raise ValueError("retries is negative")

    def fetch(self, latitude: str, longitude: str, year: int) -> dict:
        query = {
            "latitude": latitude, "longitude": longitude, "start_date": f"{year}-01-01", "end_date": f"{year}-12-31",
            "hourly": ",".join(self.variables), "timezone": self.options.get("zone", "America/Los_Angeles"),
        }
        with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(query)}", timeout=TIMEOUT_S) as answer:
            return json.load(answer).get("hourly") or {}

    def batch(self, place: str, hourly: dict, error: str | None = None) -> pa.RecordBatch:
        """An answer's hours in the columns of the schema; variables that it lacks are null."""
        times = [datetime.fromisoformat(t) for t in hourly.get("time") or []]
        columns = {v: [None if x is None else float(x) for x in (hourly.get(v) or [None] * len(times))[: len(times)]] for v in self.variables}
        columns = columns | {"location": [place] * len(times), "time": times, "error": [error] * len(times)}
        kinds = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


class FilteredArchiveReader(ArchiveReader):
    """A reader that takes over filters. Spark refuses it unless spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take over filters on location; those on time give years to ask for, and Spark still applies them to the rows."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("location",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.places = named if self.places is None else self.places & named
                continue
            value = getattr(f, "value", None)
            if column == ("time",) and isinstance(value, datetime) and value.tzinfo is None:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.least = max(self.least, value.year)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    # what comes before the first moment of a year lies in the year before
                    start = isinstance(f, LessThan) and value == datetime(value.year, 1, 1)
                    self.most = min(self.most, value.year - start)
            yield f


class ArchiveStream(DataSourceStreamReader):
    """The requests of an ArchiveReader as a stream, ``per_batch`` a batch (all, if unset).

    More options: ``state``, a folder that driver and tasks share, and ``again``,
    how many more rounds ask for the years that failed. An offset is the number
    of requests that have been given out: all of the first round, by year and
    place, then those of the next. Each answer is kept in the folder as soon as it
    comes, under its place in that order, so a query that stops within a batch,
    or a task that is lost, asks only for what has not been answered. A failed
    year gives its row of ``error`` in each round that fails, and its hours in the
    round that succeeds; a year that has been answered gives nothing in later
    rounds. A folder belongs to one checkpoint, and to one choice of places,
    years and variables: others are refused. With ``per_batch``, use a trigger by
    time: one of availableNow asks for an offset once, so it takes one batch.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.archive = ArchiveReader(schema, options)
        self.folder = Folder(options["state"])
        self.every = sorted(self.archive.requests(), key=lambda r: r[3])
        self.rounds = 1 + int(options.get("again", 0))
        self.per_batch = int(options.get("per_batch", 0))

    def initialOffset(self) -> dict:
        wanted = json.dumps([self.every, self.archive.variables])
        if (kept := self.folder.read("requests.json")) is None:
            self.folder.write("requests.json", wanted)
        elif kept != wanted:
            raise ValueError("the folder of state holds answers to other requests")
        return {"given": 0}

    def latestOffset(self) -> dict:
        self.initialOffset()
        most = len(self.every) * self.rounds
        given = int(self.folder.read("given.json") or 0)
        if given < most:
            # noted before Spark learns of it: after a restart no offset is ever less than one in Spark's log
            given = min(most, given + self.per_batch) if self.per_batch else most
            self.folder.write("given.json", str(given))
        return {"given": given}

    def partitions(self, start: dict, end: dict) -> list[YearsPart]:
        """All rounds of a request go to one task, in order."""
        n = len(self.every)
        tasks: list[list] = [[] for _ in range(self.archive.tasks)]
        for place in range(start["given"], end["given"]):
            tasks[place % n % len(tasks)].append((*self.every[place % n], place))
        return [StreamPart(t) for t in tasks if t]

    def read(self, part: StreamPart):
        n = len(self.every)
        for *request, place in part.requests:
            if any(self.folder.read(f"answer-{earlier}.json") is not None for earlier in range(place % n, place, n)):
                continue
            kept = self.folder.read(f"answer-{place}.json")
            hourly, error = (json.loads(kept), None) if kept is not None else self.archive.ask(*request)
            if kept is None and error is None:
                self.folder.write(f"answer-{place}.json", json.dumps(hourly))
            yield self.archive.batch(request[0], hourly, error)

    def commit(self, end: dict) -> None:
        pass


class StreamPart(InputPartition):
    """The requests that one task of a batch makes, each with its place in the order of all."""

    def __init__(self, requests: list[tuple]):
        super().__init__([f"{r[0]}/{r[3]}/{r[4]}" for r in requests])
        self.requests = requests


class HourlyArchive(DataSource):
    """spark.dataSource.register(HourlyArchive); spark.read or readStream, .format("hourly_archive").schema(...).options(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "hourly_archive"

    def schema(self) -> str:
        return "location string, time timestamp_ntz"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (FilteredArchiveReader if pushed else ArchiveReader)(schema, self.options)

    def streamReader(self, schema: T.StructType) -> ArchiveStream:
        return ArchiveStream(schema, self.options)
