"""The folder that the driver and every executor see."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, only a local session (as in tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hazeline-")
        spark.sparkContext.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files in a folder that driver and tasks share, for code that runs outside of Spark's own readers and writers.

    ``path`` is a URI that pyarrow knows (file, hdfs, s3) or a plain path. A file
    appears as a whole or not at all where the file system renames so.
    """

    def __init__(self, path: str):
        self.path = path

    def open(self) -> tuple[fs.FileSystem, str]:
        if ":/" not in self.path:
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path.replace("file:///", "file:/").replace("file:/", "file:///").replace("s3a://", "s3://"))

    def read(self, name: str) -> str | None:
        """The file's text, None if there is none."""
        system, root = self.open()
        try:
            with system.open_input_stream(f"{root}/{name}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def write(self, name: str, text: str) -> None:
        system, root = self.open()
        system.create_dir(root, recursive=True)
        unfinished = f"{root}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(unfinished) as f:
            f.write(text.encode())
        system.move(unfinished, f"{root}/{name}")
