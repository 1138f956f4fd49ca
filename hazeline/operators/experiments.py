"""One model for each location and dataset variant, with metrics and importances as flat tables.

Logistic models of all locations and variants are fitted together, in as many
jobs as one takes (``run_logistic``). Other models (``run``) are distributed
jobs over a location's rows alone, and several run at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators import grouped, metrics, models
from hazeline.operators.features import standardize
from hazeline.operators.stats import percent_of_total
from hazeline.operators.variants import large_enough
from hazeline.sources.shared import spool

#: Fits that run at the same time.
PARALLEL = 4
METRICS = ("accuracy", "precision", "recall", "f1", "auc")

#: Train rows and feature names to a fitted model.
Fit = Callable[[DataFrame, Sequence[str]], object]


def run(
    parts: dict[str, DataFrame],
    cols: dict[str, Sequence[str]],
    fits: dict[str, Fit],
    is_test: Column,
    by: str = "location",
    label: str = "fog",
    threshold: float = 0.5,
    least: tuple[int, int] = (100, 10),
) -> tuple[DataFrame, DataFrame]:
    """(metrics, importances) of every location, variant and model.

    ``parts`` holds the rows of each variant, ``cols`` its features. Locations
    with fewer train or test rows than ``least``, or with one class only among
    the train rows, are skipped. Features are scaled by the location's train
    rows. metrics: location, variant, model, metric, value, over the test rows;
    importances: location, variant, model, feature, importance, importance_pct.
    """
    spark = next(iter(parts.values())).sparkSession

    def one(variant: str, place: str) -> tuple[list, list]:
        rows = parts[variant].where(F.col(by) == place).select(*cols[variant], label, is_test.alias("_test"))
        rows = rows.dropna("any", subset=[*cols[variant], label]).persist()
        try:
            names = list(cols[variant])
            train = rows.where("not _test").drop("_test")
            test = standardize(rows.where("_test").drop("_test"), names, fit=train)
            train = standardize(train, names)
            found, told = [], []
            for name, fit in fits.items():
                model = fit(train, names)
                scored = models.scored(model, models.assembled(test, names))
                flat = metrics.evaluate(scored, threshold, label=label).crossJoin(F.broadcast(metrics.roc_auc(scored, label=label)))  # one row each
                pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*(F.col(m).cast("double") for m in METRICS)))).alias("metric", "value")
                found += [(place, variant, name, *r) for r in flat.select(pairs).collect()]  # five numbers
                told += [(place, variant, name, *r) for r in models.importance(model, names, spark).select("feature", "importance", "importance_pct").collect()]
            return found, told
        finally:
            rows.unpersist()

    jobs = []
    for variant, df in parts.items():
        whole = df.dropna("any", subset=[*cols[variant], label])
        enough = large_enough(whole, is_test, [by], *least).where(~is_test).groupBy(by).agg(F.count_distinct(label).alias("n")).where("n > 1")
        jobs += [(variant, r[by]) for r in enough.select(by).orderBy(by).collect()]  # one row for each location
    with ThreadPoolExecutor(PARALLEL) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(lambda job: one(*job)), jobs))
    keys = f"{by} string, variant string, model string"
    flat = spark.createDataFrame([r for found, _ in done for r in found], f"{keys}, metric string, value double")
    told = spark.createDataFrame([r for _, part in done for r in part], f"{keys}, feature string, importance double, importance_pct double")
    return flat, told


def run_logistic(
    parts: dict[str, DataFrame],
    cols: dict[str, Sequence[str]],
    is_test: Column,
    by: str = "location",
    label: str = "fog",
    threshold: float | None = 0.5,
    least: tuple[int, int] = (100, 10),
    c: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, importances) as ``run`` gives them for the logistic model, of all groups at once.

    ``threshold`` None: each group's own, that of largest f1 on its train rows.
    """
    keys = [by, "variant"]
    stacked = None
    for variant, df in parts.items():
        x = F.array(*(F.col(n).cast("double") for n in cols[variant]))
        rows = df.dropna("any", subset=[*cols[variant], label]).select(by, F.lit(variant).alias("variant"), x.alias("x"), F.col(label).cast("int").alias(label), is_test.alias("_test"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    stacked = spool(stacked, "stacked-variants")
    train = ~F.col("_test")
    sizes = stacked.groupBy(*keys).agg(F.count_if(train).alias("a"), F.count_if("_test").alias("b"), F.min(F.when(train, F.col(label))).alias("low"), F.max(F.when(train, F.col(label))).alias("high"))
    enough = sizes.where((F.col("a") >= least[0]) & (F.col("b") >= least[1]) & (F.col("low") < F.col("high"))).select(*keys)
    enough = spool(enough, "large-enough")  # its size is known then, and no group's rows meet in a task for the join
    rows = stacked.join(enough, keys, "left_semi")
    fitted = spool(grouped.fit_logistic(rows.where(train), keys, label=label, c=c), "coefficients")
    scored = grouped.scored(rows, fitted, keys)
    test = scored.where("_test")
    if threshold is None:
        own = metrics.best_threshold(metrics.sweep(scored.where(train), by=keys, label=label), keys).select(*keys, "threshold")
        counted = test.join(own, keys).groupBy(*keys).agg(*metrics.confusion(metrics.predict(F.col("score"), F.col("threshold")), F.col(label)))
        told = metrics.rates(counted)
    else:
        told = metrics.evaluate(test, threshold, keys, label=label)
    wide = told.join(metrics.roc_auc(test, keys, label=label), keys)
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*(F.col(m).cast("double") for m in METRICS)))).alias("metric", "value")
    flat = wide.select(*keys, F.lit("logistic").alias("model"), pairs)
    names = F.create_map(*(v for n, part in cols.items() for v in (F.lit(n), F.array(*map(F.lit, part)))))[F.col("variant")]
    each = fitted.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), F.transform("coefficients", F.abs).alias("importance"))).alias("f"))
    each = each.select(*keys, F.lit("logistic").alias("model"), "f.feature", "f.importance")
    return flat, percent_of_total(each, "importance", keys, name="importance_pct")
