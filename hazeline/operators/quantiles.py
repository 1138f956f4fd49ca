"""Exact quantiles with linear interpolation, for groups of any size, all groups and columns in one plan.

A sketch of bounded size brackets each quantile's rank. In a second pass, values
inside a bracket (a thousandth of a large group) are counted one by one, all
others only by the gap between brackets that they lie in. Where a group may
still hold too many values, its brackets are cut into segments again, and only
segments with a wanted rank keep their values: each round leaves a twentieth. A
window over the few counts left finds the ranks. So no task holds a group, and
the driver sees two numbers: how many rows there are and how many values a group
still holds. Should a sketch ever miss, the query fails; it never answers
wrong.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.sources.shared import spool

#: Of the sketch: its rank error is at most one in so many; brackets are a few times as wide.
ACCURACY = 10_000
MARGIN = 5 / ACCURACY
#: Values up to which a group's bracket is all of it.
WHOLE = 20_000
#: Values of one group that a window takes; brackets that hold more are cut again.
HELD = 100_000
#: Segments for each wanted rank that brackets are cut into.
SEGMENTS = 20


def summarised(values: DataFrame, keys: Sequence[str], ps: Sequence[float], value: str = "value", others: dict[str, Column] | None = None) -> DataFrame:
    """The keys, ``others`` (aggregates by name) and _q, the quantiles ``ps`` (ascending) of each group; nulls and NaN are skipped.

    In ``others``, _v is the value. Null keys are groups, too; a group without
    values has null quantiles. Rows are counted at once; if a group may be large,
    sketches (and for a giant one, rounds of narrowing) are made at once, too.
    """
    others = others or {}
    v = F.col(value).cast("double")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = values.select(key.alias("_k"), F.when(~F.isnan(v), v).alias("_v"))

    ends = [x for p in ps for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(ACCURACY))
    most = values.count()  # no group has more
    giant = most > WHOLE and most * len(ps) * (2 * MARGIN + 2 / ACCURACY) > HELD
    sketched = [sketch.alias("_ends")] if most > WHOLE else []
    groups = rows.groupBy("_k").agg(F.count("_v").alias("_total"), *sketched, *(a.alias(n) for n, a in others.items()))

    def end(i: int) -> Column:
        """The i-th end of the brackets: infinite at the ends of the range."""
        return F.lit(float("inf") if i % 2 else float("-inf")) if ends[i] in (0.0, 1.0) else F.col("_ends")[i]

    x, gap, held = F.col("_v"), F.lit(0), F.col("_v")
    if sketched:
        groups = spool(groups, "sketches")
        # only groups of more than WHOLE rows have brackets: at most one for so many rows, so they fit a broadcast and no task meets a giant group
        large = groups.where(F.col("_total") > WHOLE).select("_k", *(end(i).alias(f"_end{i}") for i in range(len(ends))))
        rows = rows.join(F.broadcast(large), "_k", "left")
        low = [F.coalesce(f"_end{2 * j}", F.lit(float("-inf"))) for j in range(len(ps))]
        high = [F.coalesce(f"_end{2 * j + 1}", F.lit(float("inf"))) for j in range(len(ps))]
        held = F.when(sum((x.between(a, b).cast("int") for a, b in zip(low, high, strict=True)), F.lit(0)) > 0, x)
        gap = sum((F.coalesce((b < x).cast("int"), F.lit(0)) for b in high), F.lit(0))
    counts = rows.groupBy("_k", gap.alias("_gap"), held.alias("_w")).agg(F.count("_v").alias("_n"))
    if giant:
        counts = _narrowed(counts, ps)

    # what passed as many brackets and lies in none comes before what lies in the next one
    order = W.partitionBy("_k").orderBy("_gap", F.col("_w").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_total", F.sum("_n").over(W.partitionBy("_k")))
    ranks = _ranks(ps)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_w")))

    picked = [at(f(r)).alias(f"_{name}{j}") for j, r in enumerate(ranks) for name, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy("_k").agg(*picked, F.first("_total").alias("_total"))
    if others:
        found = found.join(groups.select("_k", *others), "_k")

    def quantile(j: int) -> Column:
        low, high = F.col(f"_low{j}"), F.col(f"_high{j}")
        between = F.when(low == high, low).otherwise(low + (high - low) * (ranks[j] - F.floor(ranks[j])))
        missed = F.raise_error(F.lit("a sketch missed the rank of a quantile")).cast("double")
        return F.when(F.col("_total") == 0, F.lit(None)).when(low.isNotNull() & high.isNotNull(), between).otherwise(missed)

    return found.select(*(F.col(f"_k.{c}").alias(c) for c in keys), *others, F.array(*map(quantile, range(len(ps)))).alias("_q"))


def _ranks(ps: Sequence[float]) -> list[Column]:
    return [F.lit(float(p)) * (F.col("_total") - 1) for p in ps]


def _narrowed(counts: DataFrame, ps: Sequence[float]) -> DataFrame:
    """The counts, with so many of them added up that no group holds over HELD values."""
    bound = max(HELD, 4 * len(ps))
    while True:
        counts = spool(counts, "bracket-counts")
        held = counts.groupBy("_k").agg(F.count("_w").alias("held")).agg(F.max("held")).first()[0]
        if (held or 0) <= bound:
            return counts
        counts = _cut(counts, ps, bound)


def _cut(counts: DataFrame, ps: Sequence[float], bound: int) -> DataFrame:
    """One round: values of segments in which no rank lies are added up, the others kept one by one; other groups stay as they are."""
    parts = SEGMENTS * 2 * len(ps)
    grid = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    sketch = F.percentile_approx("_w", grid, F.lit(max(ACCURACY, 10 * parts)))
    pivots = counts.groupBy("_k").agg(F.count("_w").alias("_held"), sketch.alias("_pivots")).where(F.col("_held") > bound).drop("_held")
    # one row for each group of over ``bound`` values, written once for the joins that broadcast it
    pivots = spool(pivots, "pivots")
    other = counts.join(F.broadcast(pivots.select("_k")), "_k", "left_anti").select("_k", "_gap", "_w", "_n")
    below = F.size(F.filter("_pivots", lambda p: p < F.col("_w")))
    cut = counts.join(F.broadcast(pivots), "_k").withColumn("_segment", F.when(F.col("_w").isNull(), -1).otherwise(below)).drop("_pivots")

    # a group has few segments: those of earlier rounds, and the new ones of each wanted rank
    sums = cut.groupBy("_k", "_gap", "_segment").agg(F.sum("_n").alias("_n"))
    group = W.partitionBy("_k")
    order = group.orderBy("_gap", "_segment")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).withColumn("_place", F.row_number().over(order)).withColumn("_total", F.sum("_n").over(group))
    wanted = F.lit(False)
    for rank in (f(r) for r in _ranks(ps) for f in (F.floor, F.ceil)):
        wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    sums = sums.withColumn("_wanted", wanted & (F.col("_segment") >= 0))

    none = F.lit(None).cast("double").alias("_w")
    added = sums.where(~F.col("_wanted")).select("_k", F.col("_place").alias("_gap"), none, "_n")
    chosen = sums.where("_wanted").select("_k", "_gap", "_segment", "_place")  # a few for each group that is cut
    kept = cut.join(F.broadcast(chosen), ["_k", "_gap", "_segment"])
    return other.unionByName(added).unionByName(kept.select("_k", F.col("_place").alias("_gap"), "_w", "_n"))


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (for each group) with the median of each column; nulls are skipped."""
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(list(by), list(cols), "_feature", "_value")
    found = summarised(long, [*by, "_feature"], [0.5], "_value").select(*by, "_feature", F.col("_q")[0].alias("_value"))
    return found.groupBy(*by).pivot("_feature", list(cols)).agg(F.first("_value"))
