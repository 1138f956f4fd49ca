"""Imbalanced binary classifiers, stacking and importances.

Logistic regression and perceptrons are Spark ML's; forests, boosted trees with
L1, L2 and gamma and the convolutional network are ``forest``, ``boosting`` and
``convolution`` of this package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators import boosting, convolution
from hazeline.operators import forest as forests
from hazeline.operators.features import sequences, standardize
from hazeline.operators.metrics import blend
from hazeline.operators.stats import percent_of_total
from hazeline.operators.variants import class_weights
from hazeline.sources.shared import fresh_path

#: The final mix and the combined importance of the stack.
MIX = {"p_logistic": 0.1, "p_forest": 0.2, "p_boosted": 0.3, "p_sequence": 0.4}
IMPORTANCE_MIX = {"logistic": 1 / 6, "forest": 2 / 6, "boosted": 3 / 6}


def assembled(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="skip").transform(df)


def scored(model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the model's probability, without the columns that the model adds."""
    if isinstance(model, boosting.Boosted):
        return boosting.scored(model, df, name)
    if isinstance(model, forests.Forest):
        return forests.scored(model, df, name)
    out = model.transform(df)
    extra = [c for c in out.columns if c not in df.columns]
    # a model of rows without positives knows one class only, and its vectors have one place
    positive = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    return out.withColumn(name, positive).drop(*extra)


def logistic(train: DataFrame, cols: Sequence[str], label: str = "fog", c: float = 1.0, max_iter: int = 1000):
    """Balanced L2 logistic regression on scaled features; the penalty matches C over the train rows.

    The model is written to the shared folder and read back: a fresh one holds its
    summary, and so the session, which no task can take once ``observe`` was used.
    """
    data = assembled(class_weights(train, label), cols)
    fitted = LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * max(1, data.count())), standardization=False, maxIter=max_iter).fit(data)
    path = fresh_path(train.sparkSession, "logistic")
    fitted.save(path)
    return LogisticRegressionModel.load(path)


def forest(train: DataFrame, cols: Sequence[str], label: str = "fog", trees: int = 20, depth: int = 10, leaf: int = 25, seed: int = 42) -> forests.Forest:
    """Balanced forest; each node tries as many features as the square root of their number."""
    return forests.fit(train, cols, label, trees, depth, leaf, seed=seed)


def boosted(train: DataFrame, cols: Sequence[str], label: str = "fog", rounds: int = 10, depth: int = 5, step: float = 0.05, seed: int = 42, patience: int = 20) -> boosting.Boosted:
    """Boosting stops early on a fifth of the train rows, a fixed choice by hash, never on the test year."""
    return boosting.fit(train, cols, label, rounds, depth, step, patience=patience, seed=seed)


def flat_sequences(df: DataFrame, cols: Sequence[str], length: int = 24, by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """``features``: the ``length`` rows before each as one vector."""
    s = sequences(df, cols, length, by, time)
    values = F.flatten(F.transform("sequence", lambda x: F.array(*(x[c].cast("double") for c in cols))))
    # Spark may try a model on a row before the filter that drops it: those vectors keep the width
    whole = F.when(F.size("sequence") == length, values).otherwise(F.array_repeat(F.lit(0.0), length * len(cols)))
    return s.withColumn("features", array_to_vector(whole)).drop("sequence", "rn")


def sequence_net(train: DataFrame, width: int, label: str = "fog", hidden: Sequence[int] = (64,), epochs: int = 50, seed: int = 42):
    """``train``: output of ``flat_sequences``; ``width``: values of one sequence."""
    return MultilayerPerceptronClassifier(labelCol=label, layers=[width, *hidden, 2], maxIter=epochs, seed=seed, blockSize=64).fit(train)


def importance(model, cols: Sequence[str], spark) -> DataFrame:
    """feature, importance, importance_pct: impurity or split gains, |coefficients|, or mean |weights| of a net's first layer."""
    if isinstance(model, boosting.Boosted | convolution.ConvNet | forests.Forest):
        return model.importance(spark)
    if hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        first, second = model.getLayers()[:2]
        # Spark keeps a layer's weights input by input
        values = abs(model.weights.toArray()[: first * second].reshape(-1, len(cols), second)).mean(axis=(0, 2))
    table = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values, strict=False)], "feature string, importance double")
    return percent_of_total(table, "importance", name="importance_pct")


def combined_importance(parts: dict[str, DataFrame], mix: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of normalised importances."""
    out = None
    for name, w in (mix or IMPORTANCE_MIX).items():
        part = parts[name].select("feature", (F.col("importance_pct") * F.lit(w)).alias("importance_pct"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("feature").agg(F.sum("importance_pct").alias("importance_pct"))


def stack(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "fog", by: Sequence[str] = ("location",), time: str = "time", trees: int = 500, rounds: int = 10_000, patience: int = 1_000, epochs: int = 50, length: int = 24, **shape) -> tuple[DataFrame, dict]:
    """Logistic, forest, boosted and sequence models in turn, each also fed the probabilities before it.

    Returns the test rows that have a full sequence, with every layer's
    probability and ``score``, and the models. As in the original, later layers
    learn from in-sample probabilities. Sizes are the published ones.
    """
    cols = list(cols)
    scaled_train, scaled_test = standardize(train, cols), standardize(test, cols, fit=train)
    models = {"logistic": logistic(scaled_train, cols, label)}

    def add(model, name: str, source: Sequence[str], df: DataFrame) -> DataFrame:
        return scored(model, assembled(df, source), name).drop("features")

    steps = [("forest", "p_forest", forest, {"trees": trees}), ("boosted", "p_boosted", boosted, {"rounds": rounds, "patience": patience})]
    a, b = (add(models["logistic"], "p_logistic", cols, d) for d in (scaled_train, scaled_test))
    used = [*cols, "p_logistic"]
    for name, out, fit, size in steps:
        models[name] = fit(a, used, label, **size)
        a, b = (add(models[name], out, used, d) for d in (a, b))
        used = [*used, out]
    fa, fb = (convolution.windows(d, used, length, by, time) for d in (a, b))
    models["sequence"] = convolution.fit(fa, used, label, length, by, time, epochs=epochs, **shape)
    done = convolution.scored(models["sequence"], fb, "p_sequence")
    return done.withColumn("score", blend(MIX)), models
