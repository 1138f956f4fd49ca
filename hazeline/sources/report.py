"""Text reports from the flat metric and importance tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def metric_lines(metrics: DataFrame) -> DataFrame:
    """line, position: one block for each location and variant, numbers with four digits."""
    label = F.format_string("%s - %s (%s)", F.initcap(F.replace("location", F.lit("_"), F.lit(" "))), "variant", "model")
    head = metrics.groupBy("location", "variant", "model").agg(F.count("*").alias("n"))
    heads = head.select("location", "variant", "model", F.lit("").alias("k"), label.alias("line"))
    lines = metrics.select("location", "variant", "model", F.concat("split", F.lit(" "), "metric").alias("k"), F.format_string("  %-24s%12.4f", F.concat("split", F.lit(" "), "metric"), "value").alias("line"))
    return heads.unionByName(lines)


def importance_lines(found: DataFrame) -> DataFrame:
    label = F.format_string("%s - %s (%s)", F.initcap(F.replace("location", F.lit("_"), F.lit(" "))), "variant", "model")
    heads = found.select("location", "variant", "model", F.lit(None).cast("double").alias("k"), label.alias("line")).distinct()
    lines = found.select("location", "variant", "model", F.col("importance_pct").alias("k"), F.format_string("  %-32s%12.4f%9.2f%%", "feature", "importance", "importance_pct").alias("line"))
    return heads.unionByName(lines)


def summary_lines(metrics: DataFrame) -> DataFrame:
    """section, k, line: each variant's means over locations, and how far they lie from the first variant's (by name)."""
    means = metrics.groupBy("model", "variant", "metric").agg(F.avg("value").alias("value"), F.count_distinct("location").alias("n"))
    section = F.format_string("%s over %d locations", "model", "n")
    base = means.groupBy("model", "metric").agg(F.min_by("value", "variant").alias("base"))
    lines = means.join(base, ["model", "metric"]).select(
        section.alias("section"), F.concat_ws(" ", "metric", "variant").alias("k"),
        F.format_string("  %-12s%-24s%12.4f%+12.4f", "metric", "variant", "value", F.col("value") - F.col("base")).alias("line"),
    )
    return lines.unionByName(lines.select("section", F.lit("").alias("k"), F.col("section").alias("line")).distinct())


def balance_lines(df: DataFrame, label: str = "fog", by: str = "location") -> DataFrame:
    """k, line: rows, positive rows and their share of each group."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    title = F.initcap(F.replace(by, F.lit("_"), F.lit(" ")))
    return counts.select(F.col(by).alias("k"), F.format_string("  %-24s%12d%12d%9.2f%%", title, "n", "pos", F.col("pos") / F.col("n") * 100).alias("line"))


def threshold_lines(found: DataFrame, by: str = "location") -> DataFrame:
    """k, line: the best threshold of each group and its f1 (``metrics.best_threshold``)."""
    title = F.initcap(F.replace(by, F.lit("_"), F.lit(" ")))
    return found.select(F.col(by).alias("k"), F.format_string("  %-24s%8.2f%12.4f", title, "threshold", "f1").alias("line"))


def write_metrics(metrics: DataFrame, path: str, rows: DataFrame | None = None, thresholds: DataFrame | None = None) -> None:
    """One text file: class balance of ``rows``, best thresholds, the blocks of all locations, and the summary over them.

    Metric tables are as large as locations times variants times metrics.
    """
    order = ("part", "location", "variant", "model", "k")
    blank = lambda df, part: df.select(F.lit(part).alias("part"), *(F.lit("").alias(c) for c in order[1:4]), "k", "line")
    head = lambda df, title: df.select("k", "line").unionByName(df.sparkSession.createDataFrame([("", title)], "k string, line string"))
    parts = [metric_lines(metrics).select(F.lit(3).alias("part"), *order[1:], "line")]
    parts.append(summary_lines(metrics).select(F.lit(4).alias("part"), F.col("section").alias("location"), F.lit("").alias("variant"), F.lit("").alias("model"), "k", "line"))
    if rows is not None:
        parts.append(blank(head(balance_lines(rows), "Class balance"), 1))
    if thresholds is not None:
        parts.append(blank(head(threshold_lines(thresholds), "Thresholds"), 2))
    reduce(DataFrame.unionByName, parts).orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_importance(found: DataFrame, path: str) -> None:
    lines = importance_lines(found).orderBy("location", "variant", "model", F.col("k").desc_nulls_first()).select("line")
    lines.coalesce(1).write.mode("overwrite").text(path)


def counters(df: DataFrame, **conditions) -> DataFrame:
    """Row count and counts of named conditions, in one row."""
    return df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def counted(df: DataFrame, write: Callable[[DataFrame], None], **conditions: Column) -> dict[str, int]:
    """The same counts, taken while ``write`` writes ``df``: no second job, and no second reading of its sources.

    Counts are those of the tasks whose output stays; all are 0 for an empty
    table. ``write`` must run one job that uses all of ``df``.
    """
    watch = Observation()
    write(df.observe(watch, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items())))
    return watch.get
