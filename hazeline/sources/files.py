"""File sources and sinks: CSV and Parquet by layer, one folder per location or one file per location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Rows of one key that a task sorts and writes.
FILE_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, time_format: str = TIME_FORMAT) -> DataFrame:
    """CSV with a header and a fixed schema; empty fields are nulls."""
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", time_format).option("enforceSchema", False).csv(path)


def read_located(spark: SparkSession, pattern: str, schema: T.StructType, name: str = r"location_(\w+?)_", time_format: str = TIME_FORMAT, part: str = "name") -> DataFrame:
    """All files of a glob, the location taken from each file's name (or its whole path: part="path")."""
    rest = T.StructType([f for f in schema if f.name != "location"])
    df = read_csv(spark, pattern, rest, time_format)
    return df.select(F.regexp_extract(F.col(f"_metadata.file_{part}"), name, 1).alias("location"), *rest.names)


def locations_with_all(tables: Sequence[DataFrame], key: str = "location") -> DataFrame:
    """Locations that every table has; others are skipped."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ("location",)) -> None:
    _dealt(df, by).write.mode("overwrite").partitionBy(*by).option("header", True).option("timestampNTZFormat", TIME_FORMAT).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ("location",)) -> None:
    _dealt(df, by).write.mode("overwrite").partitionBy(*by).parquet(path)


def _dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files of even size: Spark splits large keys and joins small ones.

    It does so by compressed bytes, of which a task's sort takes many times as
    much. So rows of keys are counted at once; where one has over FILE_ROWS, all
    are dealt out in cells of about so many.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (sizes["most"] or 0) <= FILE_ROWS:
        return df.hint("rebalance", *by)
    cell = F.pmod(F.xxhash64(*df.columns), F.lit(-(-sizes["most"] // FILE_ROWS)))
    return df.repartition(max(-(-sizes["all"] // FILE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, cell)


def fan_out(parts: dict[str, DataFrame], path: str, source: DataFrame | None = None) -> None:
    """One folder per variant; ``source``, which all come from, is read once."""
    kept = source.persist() if source is not None else None
    try:
        for name, df in parts.items():
            write_parquet(df, f"{path}/{name}")
    finally:
        if kept is not None:
            kept.unpersist()


def literal_table(spark: SparkSession, nested: dict, names: Sequence[str], value: str = "value") -> DataFrame:
    """Nested dictionaries to rows: a key of each depth in a column of its own, the numbers in ``value``."""
    rows: list[tuple] = []

    def walk(x, keys: tuple) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, (*keys, k))
        else:
            rows.append((*keys, float(x)))

    walk(nested, ())
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + f", {value} double")
