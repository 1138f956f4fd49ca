"""Classifier metrics as aggregates of scored rows (score, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.functions.scalar import grid, ratio

#: 0.10, 0.15, ... as start + i * step.
THRESHOLDS = grid(0.1, 0.6, 0.05)[:10]


def confusion(pred: Column, label: Column) -> list[Column]:
    yes, bad = pred == 1, label == 1
    return [F.count_if(yes & bad).alias("tp"), F.count_if(yes & ~bad).alias("fp"), F.count_if(~yes & bad).alias("fn"), F.count_if(~yes & ~bad).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from tp, fp, fn, tn; 0 where a denominator is."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def predict(score: Column, threshold: float | Column, strict: bool = False) -> Column:
    """1 from the threshold on (or strictly above it)."""
    return ((score > threshold) if strict else (score >= threshold)).cast("int")


def evaluate(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), score: str = "score", label: str = "fog", strict: bool = False) -> DataFrame:
    return rates(df.groupBy(*by).agg(*confusion(predict(F.col(score), F.lit(threshold), strict), F.col(label))))


def sweep(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = (), score: str = "score", label: str = "fog") -> DataFrame:
    """Metrics at every threshold in one pass: conditional counts, no copy of the rows."""
    cols = []
    for i, t in enumerate(thresholds):
        yes, bad = F.col(score) >= F.lit(float(t)), F.col(label) == 1
        cols.append(F.struct(
            F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), F.count_if(yes & bad).alias("tp"), F.count_if(yes & ~bad).alias("fp"),
            F.count_if(~yes & bad).alias("fn"), F.count_if(~yes & ~bad).alias("tn"),
        ))
    wide = df.groupBy(*by).agg(F.array(*cols).alias("_all"))
    return rates(wide.select(*by, F.inline("_all")).drop("i"))


def best_threshold(swept: DataFrame, by: Sequence[str] = (), default: float = 0.5) -> DataFrame:
    """The threshold of largest f1, the lowest of equals; ``default`` if all are 0."""
    best = F.max(F.struct(F.col("f1").alias("f1"), (-F.col("threshold")).alias("t")))
    out = swept.groupBy(*by).agg(best.alias("_b"))
    return out.select(*by, F.when(F.col("_b.f1") > 0, -F.col("_b.t")).otherwise(F.lit(default)).alias("threshold"), F.col("_b.f1").alias("f1"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fog", block: float = 1e-3) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks; 0 if one class is absent.

    Rows are first counted by distinct score; the running counts come from
    windows within blocks of scores and the blocks' sums, so a large group
    isn't ordered in one task.
    """
    s = F.col(score).cast("double")
    counts = df.where(s.isNotNull()).groupBy(*by, s.alias("_s")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n"))
    counts = counts.withColumn("_block", F.floor(F.col("_s") / F.lit(block)))
    sums = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_bn"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    inside = W.partitionBy(*by, "_block").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    keyed = counts.withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = keyed.join(sums, [*by, "_block"]).withColumn("_below", F.col("_before") + F.col("_below"))
    out = joined.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    return out.select(*by, ratio(F.col("_u"), F.col("_pos") * F.col("_neg")).alias("auc"))


def blend(scores: dict[str, float]) -> Column:
    """Weighted sum of score columns."""
    return sum((F.lit(float(w)) * F.col(c) for c, w in scores.items()), F.lit(0.0))


def average(metrics: DataFrame, by: Sequence[str] = ("model", "variant", "metric")) -> DataFrame:
    """Mean of each metric over locations."""
    return metrics.groupBy(*by).agg(F.avg("value").alias("value"))
