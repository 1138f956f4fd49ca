"""A sink of exactly named CSV files, one for each location or block of one, with a commit of tasks and of the job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import compute, csv, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from hazeline.operators.positions import numbered
from hazeline.sources.files import TIME_FORMAT
from hazeline.sources.shared import Folder


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has finished, in the folder of its attempt."""

    attempt: str
    names: list[str]


class NamedWriter(DataSourceArrowWriter):
    """Option ``file``: the column that names each row's file; it isn't written.

    A task writes to a folder of its attempt; the job's commit moves the files of
    the attempts that Spark chose to their places and then writes ``_SUCCESS``. So
    a task that fails, or runs twice, leaves nothing, and neither does a job that
    fails before its commit. Rows of a file must lie in one task, side by side:
    a name that comes twice fails the job before any file is moved.
    """

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.column, self.overwrite = options["file"], overwrite
        self.folder = Folder(options["path"])
        self.job = f"_temporary-{uuid.uuid4().hex}"
        if self.column not in schema.names:
            raise ValueError(f"no column {self.column}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = self.folder.open()
        attempt, names = uuid.uuid4().hex, []
        folder = f"{root}/{self.job}/{attempt}"
        system.create_dir(folder, recursive=True)
        writer = stream = None
        try:
            for batch in iterator:
                column = batch.column(self.column)
                rest = batch.drop_columns([self.column])
                at = 0
                while at < len(batch):
                    name = column[at].as_py()
                    same = compute.fill_null(compute.equal(column.slice(at), name), False)
                    end = compute.index(same, False).as_py()
                    end = len(batch) if end < 0 else at + end
                    if not names or name != names[-1]:
                        check_name(name)
                        if name in names:
                            raise ValueError(f"rows of {name} don't lie side by side")
                        if writer:
                            writer.close()
                            stream.close()
                        stream = system.open_output_stream(f"{folder}/{name}")
                        writer = csv.CSVWriter(stream, rest.schema)
                        names.append(name)
                    writer.write_batch(rest.slice(at, end - at))
                    at = end
        finally:
            if writer:
                writer.close()
                stream.close()
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self.folder.open()
        done = [(m.attempt, name) for m in messages if m for name in m.names]
        names = {name for _, name in done}
        if len(names) < len(done):
            self.abort(messages)
            raise ValueError("rows of a file lie in several tasks")
        system.create_dir(root, recursive=True)
        before = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name != self.job]
        if self.overwrite:
            for f in before:
                system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        elif taken := sorted(names & {f.base_name for f in before}):
            self.abort(messages)
            raise ValueError(f"{taken[0]} is there already")
        for attempt, name in done:
            system.move(f"{root}/{self.job}/{attempt}/{name}", f"{root}/{name}")
        self.abort(messages)
        self.folder.write("_SUCCESS", "")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self.folder.open()
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def check_name(name: str | None) -> None:
    if not name or name[0] in "._" or "/" in name:
        raise ValueError(f"{name!r} can't name a file")


class NamedFiles(DataSource):
    """spark.dataSource.register(NamedFiles); df.write.format("named_files").option("file", column).mode(...).save(path)"""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(schema, self.options, overwrite)


def write_named(df: DataFrame, path: str, name: str = "location_{location}.csv", rows: int | None = None, order: Sequence[str] = ("time",), overwrite: bool = True) -> None:
    """One CSV file with a header for each ``name``, whose {columns} are filled in and not written; rows are ordered by ``order``.

    A file is one task's work. With ``rows``, a series (by the named columns, in
    the order of ``order``, whose first is a time) is cut into files of at most
    that many rows, numbered from 0 by {n} in ``name``: so a location of any size
    spreads over tasks. Without it, a file holds its whole location, in one task.
    Nulls are empty fields, empty texts are quoted, times have seconds. A null in
    a named column, or a name with a slash or a leading dot or underscore, fails the job.
    """
    parts = re.split(r"\{(\w+)\}", name)
    keys = list(dict.fromkeys(k for k in parts[1::2] if k != "n"))
    if (rows is None) == ("n" in parts[1::2]):
        raise ValueError("{n} in a name goes with rows")
    if rows is not None:
        df = numbered(df, keys, order, name="_n").withColumn("_n", F.floor((F.col("_n") - 1) / rows))
        parts = [*parts[:1], *("_n" if i % 2 == 0 and p == "n" else p for i, p in enumerate(parts[1:]))]
    file = F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)))
    dealt = df.withColumn("_file", file).repartition("_file").sortWithinPartitions("_file", *order).drop(*keys, "_n")
    times = [f.name for f in dealt.schema if isinstance(f.dataType, T.TimestampNTZType | T.TimestampType)]
    dealt = dealt.withColumns({c: F.date_format(c, TIME_FORMAT) for c in times})
    df.sparkSession.dataSource.register(NamedFiles)
    dealt.write.format("named_files").option("file", "_file").mode("overwrite" if overwrite else "append").save(path)
