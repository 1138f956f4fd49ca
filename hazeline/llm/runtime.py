"""Small helpers shared by the operators: shared storage and stable row keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.sources.shared import shared_dir, spool  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(df[name], F.lit(""))


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a (doc_id, text) row; identical rows share them and get identical results."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit("row"), text, doc_id).alias("k2")]


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (as text, so that null ids cost no integer its last digits in pandas) and text; nothing else."""
    return docs.select(docs[id_col].cast("string").alias("id"), text_column(docs, text_col).alias("text"))


def restored(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Give the id its type and name back."""
    rest = [c for c in df.columns if c != "id"]
    return df.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *rest)


def spool_alone(df: DataFrame, name: str) -> DataFrame:
    """``spool``, but the shuffles behind the table go when it is written, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return spool(df, name)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def drop_spool(df: DataFrame) -> None:
    """Delete a table that ``spool`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def whole_groups(batches: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from batches sorted by ``key``, each of at least ``rows`` rows but for the last."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if len(pdf):
            held.append(pdf)
            size += len(pdf)
        if size >= rows:
            every = pd.concat(held)
            last = (every[key] == every[key].iloc[-1]).to_numpy()
            if not last.all():
                yield every[~last]
                every = every[last]
            held, size = [every], len(every)
    if held:
        yield pd.concat(held)
