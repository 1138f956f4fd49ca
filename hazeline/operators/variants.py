"""Combined table, controlled dataset variants and temporal splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.scalar import in_year, not_in_year, parse_visibility
from hazeline.operators.asof import nearest
from hazeline.schema import AIR, INFERRED, WEATHER

WITHOUT, WITH, REDUCED = "without_aqi", "with_aqi", "without_aqi_reduced"


def combine(weather: DataFrame, air: DataFrame, reports: DataFrame, tolerance_minutes: float = 30) -> DataFrame:
    """Weather with air (left join by hour) and the nearest visibility report; rows without one go."""
    joined = weather.select("location", "time", *WEATHER, *INFERRED).join(air.select("location", "time", *AIR), ["location", "time"], "left")
    seen = reports.select("location", F.col("DATE").alias("time"), parse_visibility(F.col("VIS")).cast("double").alias("visibility_meters")).dropna()
    return nearest(joined, seen, ["visibility_meters"], tolerance_minutes, order=["visibility_meters"]).drop("diff_minutes").dropna(subset=["visibility_meters"])


def variants(combined: DataFrame, extra: Sequence[str] = AIR) -> dict[str, DataFrame]:
    """All rows without the extra columns; rows that have all of them, with and without them."""
    full = combined.dropna("any", subset=list(extra))
    return {WITHOUT: combined.drop(*extra), WITH: full, REDUCED: full.drop(*extra)}


def stacked(parts: dict[str, DataFrame], name: str = "variant") -> DataFrame:
    """All variants in one table, missing columns as nulls."""
    out = None
    for key, df in parts.items():
        df = df.withColumn(name, F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def temporal_split(df: DataFrame, test_year: int, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """(all other years, the test year); both filters are ranges of time and reach the scan."""
    return df.where(not_in_year(F.col(time), test_year)), df.where(in_year(F.col(time), test_year))


def large_enough(df: DataFrame, is_test: Column, by: Sequence[str], train: int = 100, test: int = 10) -> DataFrame:
    """Rows of the groups that have at least so many train and test rows."""
    sizes = df.groupBy(*by).agg(F.count_if(~is_test).alias("_train"), F.count_if(is_test).alias("_test"))
    return df.join(sizes.where((F.col("_train") >= train) & (F.col("_test") >= test)).select(*by), list(by), "left_semi")


def complete(df: DataFrame, by: str = "location", part: str = "variant", parts: int = 3) -> DataFrame:
    """Rows of the groups in which all ``parts`` occur."""
    whole = df.groupBy(by).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == parts)
    return df.join(whole.select(by), by, "left_semi")


def class_weights(df: DataFrame, label: str = "fog", name: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    """n / (2 * n of the row's class) of each row; 1 if a class is absent."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"))
    if by:
        joined = df.join(counts, list(by))
    else:
        n, pos = counts.first()
        joined = df.withColumn("_n", F.lit(n)).withColumn("_pos", F.lit(pos or 0))
    own = F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_n"))
    return joined.withColumn(name, F.when(both, F.col("_n") / (2.0 * own)).otherwise(F.lit(1.0))).drop("_n", "_pos")


def positive_scale(df: DataFrame, label: str = "fog") -> Column:
    """n negative / n positive as an aggregate, 1 without positives."""
    pos = F.sum(F.col(label).cast("long"))
    return F.when(pos > 0, (F.count("*") - pos) / pos).otherwise(F.lit(1.0))
