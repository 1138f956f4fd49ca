"""Descriptive statistics, rates, trends and correlations, each as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.functions.scalar import trunc_ntz
from hazeline.operators.quantiles import summarised


def long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row for each value; columns become doubles."""
    plain = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in cols))
    return plain.unpivot(list(ids), list(cols), name, value)


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, min, max, median, range, mean, sample deviation of each column (and group); ``no_data`` if all are null."""
    return _described(long(df, by, cols), [*by, "feature"])


def describe_rollup(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same for each group and for all prefixes of ``by`` down to the first, as a rollup would give, in one pass over ``df``."""
    values = long(df, by, cols)
    level = F.explode(F.sequence(F.lit(1), F.lit(len(by)))).alias("_level")
    each = values.select(level, *by, "feature", "value")
    each = each.select("_level", *(F.when(F.col("_level") > i, F.col(c)).alias(c) for i, c in enumerate(by)), "feature", "value")
    return _described(each, ["_level", *by, "feature"]).drop("_level")


def _described(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("_v")
    found = {
        "n": F.count(v), "min": F.min(v), "max": F.max(v), "range": F.max(v) - F.min(v), "mean": F.avg(v), "std": F.stddev_samp(v), "no_data": F.count(v) == 0,
    }
    return summarised(values, keys, [0.5], others=found).select(*keys, "n", "min", "max", F.col("_q")[0].alias("median"), "range", "mean", "std", "no_data")


def histogram(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Occurrences of each value; nulls are left out."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name)).agg(F.count("*").alias("n"))


def yearly_rate(df: DataFrame, label: str = "fog", time: str = "time", before: int | None = None) -> DataFrame:
    """year, n, positives, rate_pct; years from ``before`` on are left out after grouping."""
    out = df.groupBy(F.year(time).alias("year")).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    out = out.withColumn("rate_pct", F.col("positives") / F.col("n") * 100)
    return out.where(F.col("year") < before) if before else out


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def monthly_mean(df: DataFrame, col: str, by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """Mean of each month (and group); ``by=()`` pools all rows."""
    return df.groupBy(*by, trunc_ntz("month", F.col(time)).alias("month")).agg(F.avg(col).alias("mean"))


def zero_fraction(df: DataFrame, col: str, by: Sequence[str] = ("location",), digits: int = 2) -> DataFrame:
    """Share of rows that are 0 (nulls are not), as a fraction rounded half to even."""
    zero = F.coalesce(F.col(col) == 0, F.lit(False)).cast("double")
    scale = float(10**digits)
    return df.groupBy(*by).agg((F.rint(F.avg(zero) * scale) / scale).alias("zero_frac"))


def correlations(df: DataFrame, cols: Sequence[str], target: str, by: Sequence[str] = ("location",)) -> DataFrame:
    """Pearson r of each column with the target, over rows that have both, for each group."""
    values = long(df, [*by, target], [c for c in cols if c != target])
    return values.groupBy(*by, "feature").agg(F.corr("value", target).alias("r")).withColumn("abs_r", F.abs("r"))


def mean_correlations(found: DataFrame) -> DataFrame:
    """mean_r, mean_abs_r (of |r|) and abs_mean_r (|mean r|) over groups."""
    return found.groupBy("feature").agg(F.avg("r").alias("mean_r"), F.avg(F.abs("r")).alias("mean_abs_r")).withColumn("abs_mean_r", F.abs("mean_r"))


def category_means(found: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Mean |r| of each category in each location, then over locations; ``categories``: feature to category."""
    label = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))
    inner = found.withColumn("category", label[F.col("feature")]).where(F.col("category").isNotNull())
    inner = inner.groupBy("location", "category").agg(F.avg("abs_r").alias("mean_abs_r"))
    return inner.groupBy("category").agg(F.avg("mean_abs_r").alias("mean_abs_r"))


def wide(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """Long to wide: one column for each of the ``values`` of ``column``."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value))


def boxplot(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (the last values within 1.5 interquartile ranges) of each column and group."""
    values = long(df, by, cols).where(F.col("value").isNotNull())
    keys = [*by, "feature"]
    q = summarised(values, keys, [0.25, 0.5, 0.75])
    q = q.select(*keys, *(F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = values.join(q, keys).where((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach))
    ends = inside.groupBy(*keys).agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    return q.join(ends, keys)


def percent_of_total(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "pct") -> DataFrame:
    """100 * value / sum of the group; 0 if the sum is 0."""
    if not by:
        total = df.agg(F.sum(col)).first()[0] or 0.0
        return df.withColumn(name, F.col(col) / F.lit(total) * 100 if total > 0 else F.lit(0.0))
    joined = df.join(df.groupBy(*by).agg(F.sum(col).alias("_sum")), list(by))
    return joined.withColumn(name, F.when(F.col("_sum") > 0, F.col(col) / F.col("_sum") * 100).otherwise(F.lit(0.0))).drop("_sum")


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, as an aggregate: no group meets in one task."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*by, *(F.col(f"_first.{c}").alias(c) for c in (*order, *rest)))


def in_order(df: DataFrame, col: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row's value in a given order."""
    place = F.create_map(*(F.lit(x) for i, v in enumerate(order) for x in (v, i)))
    return df.withColumn(name, place[F.col(col)])


def differences(df: DataFrame, key: str, part: str, value: str, a: str, b: str) -> DataFrame:
    """value of part ``a`` minus value of part ``b`` for each key."""
    w = wide(df, [key], part, [a, b], value)
    return w.select(key, (F.col(a) - F.col(b)).alias("difference"))


def elbow(df: DataFrame, k: str = "k", inertia: str = "inertia") -> DataFrame:
    """The k after the largest drop of the percent decrease: argmax(rate[i-1] - rate[i]) + 2 places into the list."""
    w = W.orderBy(k)  # one row for each k that was tried
    d = df.withColumn("_rate", (F.lag(inertia).over(w) - F.col(inertia)) / F.lag(inertia).over(w) * 100)
    d = d.withColumn("_drop", F.lag("_rate").over(w) - F.col("_rate")).where(F.col("_drop").isNotNull())
    return d.agg(F.max_by(k, F.struct(F.col("_drop"), -F.col(k))).alias("k"))
