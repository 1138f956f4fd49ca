"""Models trained by Spark aggregates, against finite differences, brute force and closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import boosting, cluster, convolution, forest, grouped, metrics

# --- convolutional network


def test_gradient_agrees_with_differences():
    rnd = np.random.default_rng(0)
    net = convolution.ConvNet(("a", "b"), 7, filters=(3, 4), dense=(5,), seed=1)
    net.theta = net.theta + rnd.normal(0, 0.1, len(net.theta))
    x, y, w = rnd.normal(size=(6, 7, 2)), rnd.integers(0, 2, 6).astype(float), rnd.uniform(0.5, 2, 6)
    loss, grad = net.gradient(x, y, w)
    whole = lambda: net.gradient(x, y, w)[0] + net.penalty()[0]
    grad = grad + net.penalty()[1]
    plain = net.theta.copy()
    for k in rnd.permutation(len(plain))[:60]:
        found = []
        for e in (1e-6, -1e-6):
            net.theta = plain.copy()
            net.theta[k] += e
            found.append(whole())
        assert abs((found[0] - found[1]) / 2e-6 - grad[k]) < 1e-4
    assert abs(net.losses(x, y) @ w - loss) < 1e-9


def window_rows(spark, n, seed, hours=24):
    """Two series; the label is whether a dip of a certain shape lies anywhere in the window, whatever its level."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        v = [rnd.gauss(0, 1) for _ in range(hours)]
        hit = k % 2
        at = rnd.randrange(1, hours - 1)
        v[at - 1 : at + 2] = [3.0, -3.0, 3.0] if hit else [3.0, 3.0, -3.0]
        out.append((f"l{k % 2 if k % 4 < 2 else 0}", k, v, hit))
    return spark.createDataFrame(out, "location string, time long, values array<double>, fog int")


def test_one_step_is_the_same_for_any_partitioning(spark):
    df = window_rows(spark, 200, 1).select("values", F.col("fog").cast("double").alias("label"), F.lit(1.0).alias("weight"), F.when(F.col("time") % 5 == 0, -1).otherwise(F.col("time") % 2).alias("batch"))
    net = convolution.ConvNet(("x",), 24, filters=(8, 8), dense=(6,))
    found = [convolution.step_sums(df.repartition(n), net, 0, True) for n in (1, 5)]
    assert found[0][0]["n"] == 80 and found[0][0]["check_n"] == 40
    moved = [convolution.Adam().moved(net.theta, g / told["n"]) for told, g in found]
    assert np.allclose(moved[0], moved[1], atol=1e-9) and not np.allclose(moved[0], net.theta)
    assert math.isclose(found[0][0]["check_loss"], found[1][0]["check_loss"])


def test_network_finds_a_local_pattern(spark):
    """A dip anywhere in the window: the convolution finds it, the perceptron on flat windows hardly."""
    from hazeline.operators import models

    rows = window_rows(spark, 1200, 2).withColumn("time", F.timestamp_seconds(F.col("time") * 3600))
    train, test = rows.where("hour(time) div 2 % 4 > 0").persist(), rows.where("hour(time) div 2 % 4 = 0").persist()
    net = convolution.fit(train, ["x"], epochs=20, batches=2, rate=0.01, filters=(16, 16), dense=(16,), l2=0.0)
    auc = metrics.roc_auc(convolution.scored(net, test), []).first()["auc"]
    vectors = lambda df: df.withColumn("features", models.array_to_vector("values"))
    flat = models.sequence_net(vectors(train), 24)
    other = metrics.roc_auc(models.scored(flat, vectors(test)), []).first()["auc"]
    assert auc > 0.95 and auc > other + 0.05


def test_first_kernel_importance(spark):
    net = convolution.ConvNet(("a", "b"), 4, filters=(2,), dense=(2,))
    kernel = net.layers()[0].reshape(3, 2, 2)
    kernel[:, 0], kernel[:, 1] = 3.0, -1.0
    assert {r["feature"]: r["importance_pct"] for r in net.importance(spark).collect()} == {"a": 75.0, "b": 25.0}


def test_patience_keeps_the_best_weights(spark, monkeypatch):
    """Validation losses that fall twice and then rise: training stops after ``patience`` epochs with the weights of the second."""
    losses, seen = iter([5.0, 4.0, 6.0, 6.0, 6.0]), []

    def sums(rows, net, batch, check):
        seen.append(net.theta.copy())
        return {"loss": 1.0, "n": 1.0, "check_loss": next(losses), "check_n": 1.0}, np.ones(len(net.theta))

    monkeypatch.setattr(convolution, "step_sums", sums)
    df = window_rows(spark, 20, 3).withColumn("time", F.timestamp_seconds(F.col("time") * 3600))
    net = convolution.fit(df, ["x"], epochs=50, patience=3, batches=1, filters=(2,), dense=(2,), l2=0.0)
    assert len(seen) == 5 and np.array_equal(net.theta, seen[1])


# --- boosting


def brute_split(x, g, h, p):
    """Best (gain, feature, threshold) over all values as thresholds."""
    score = lambda a, b: max(abs(a) - p.alpha, 0) ** 2 / (b + p.lam)
    best = None
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            if min(h[left].sum(), h[~left].sum()) < p.least:
                continue
            gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
            if gain >= p.gamma and gain > 0 and (best is None or gain > best[0] + 1e-12):
                best = gain, f, t
    return best


def brute_tree(x, g, h, p, depth, step):
    """Predictions of one tree by exact search."""
    found = brute_split(x, g, h, p) if depth else None
    if not found:
        return np.full(len(x), step * p.value(g.sum(), h.sum()))
    left = x[:, found[1]] <= found[2]
    out = np.zeros(len(x))
    for side in (left, ~left):
        out[side] = brute_tree(x[side], g[side], h[side], p, depth - 1, step)
    return out


@pytest.mark.parametrize(("alpha", "lam", "gamma", "least"), [(1.0, 2.0, 0.1, 3.0), (0.0, 0.0, 0.0, 0.5), (4.0, 1.0, 3.0, 1.0)])
def test_trees_equal_exact_search(spark, alpha, lam, gamma, least):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 12, (150, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rnd.random(150) < 0.1)).astype(float)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, fog int")
    p = boosting.Penalties(alpha, lam, gamma, least)
    model = boosting.fit(df, ["a", "b", "c"], rounds=3, depth=3, step=0.3, penalties=p, rows_used=1.0, by_tree=1.0, by_level=1.0, validation=df.limit(0))
    weight = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    margin = np.zeros(len(x))
    for _ in range(3):
        q = 1 / (1 + np.exp(-margin))
        margin = margin + brute_tree(x, weight * (q - y), weight * q * (1 - q), p, 3, 0.3)
    assert np.allclose(model.margin(model.bins(x)), margin, atol=1e-9)


def test_missing_values_go_where_they_gain_most(spark):
    rows = [(None if k % 3 == 0 else float(k % 7), 1 if k % 3 == 0 else 0) for k in range(120)]
    df = spark.createDataFrame(rows, "a double, fog int")
    model = boosting.fit(df, ["a"], rounds=5, depth=2, step=0.5, penalties=boosting.Penalties(0, 0, 0, 0), rows_used=1.0, validation=df)
    got = {(r["a"], r["fog"]): r["score"] for r in boosting.scored(model, df).collect()}
    assert all(s > 0.8 if fog else s < 0.2 for (_, fog), s in got.items())


def test_boosting_stops_on_a_fold(spark):
    """Labels of the fold are the opposite: each tree makes it worse, so none stays."""
    df = spark.createDataFrame([(float(k % 10), int(k % 10 > 4)) for k in range(200)], "a double, fog int")
    against = df.withColumn("fog", 1 - F.col("fog"))
    model = boosting.fit(df, ["a"], rounds=30, step=0.3, patience=4, validation=against)
    assert not model.trees and len(model.history) == 5 and model.history == sorted(model.history)
    again = boosting.fit(df, ["a"], rounds=12, step=0.3, validation=df)
    assert len(again.trees) == 12 and again.history == sorted(again.history, reverse=True)


def test_boosting_finds_the_planted_feature(spark):
    rnd = random.Random(4)
    rows = [(*(rnd.random() for _ in range(4)), k) for k in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k long").withColumn("fog", (F.col("b") + F.col("a") * 0.1 > 0.6).cast("int"))
    model = boosting.fit(df, ["a", "b", "c", "d"], rounds=12, depth=3, step=0.3)
    top = model.importance(spark).orderBy(F.desc("importance")).first()
    assert top["feature"] == "b" and metrics.roc_auc(boosting.scored(model, df), []).first()["auc"] > 0.98
    for odd in (df.where("fog = 0"), df.limit(0)):
        flat = boosting.fit(odd, ["a", "b"], rounds=3)
        assert all(t.feature == [-1] for t in flat.trees)


# --- logistic regressions of all groups


def exact_logistic(x, y, c=1.0):
    """Intercept and coefficients of one balanced regression on scaled columns, by many small-step Newton iterations."""
    dev = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, pull = np.zeros(z.shape[1]), np.append(0, np.full(x.shape[1], 1 / c))
    for _ in range(200):
        q = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(pull), z.T @ (w * (q - y)) + pull * beta)
    return beta


def grouped_rows(seed, groups):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        width = 1 + g % 3
        for _ in range(60 if g else 900):  # the first group holds most rows
            x = [rnd.gauss(g, 1 + g) for _ in range(width)]
            rows.append((f"l{g}" if g != 1 else None, "v", x, int(x[0] - g + rnd.gauss(0, 1) > 0.5)))
    return rows


def test_groups_agree_with_single_fits(spark):
    rows = grouped_rows(1, 6)
    odd = [("l2", "v", None, 1), ("l2", "v", [1.0, None, 2.0], 0), ("l2", "v", [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows + odd, "location string, variant string, x array<double>, fog int").repartition(5)
    fitted = grouped.fit_logistic(df, ["location", "variant"]).collect()
    assert len(fitted) == 6
    for r in fitted:
        mine = [(x, y) for place, _, x, y in rows if place == r["location"]]
        want = exact_logistic(np.array([x for x, _ in mine]), np.array([y for _, y in mine], float))
        assert r["n"] == len(mine) and np.allclose([r["intercept"], *r["coefficients"]], want, atol=1e-6)


def test_grouped_scores(spark):
    df = spark.createDataFrame(grouped_rows(2, 3), "location string, variant string, x array<double>, fog int")
    out = grouped.scored(df, grouped.fit_logistic(df, ["location"]), ["location"])
    assert out.columns == [*df.columns, "score"] and out.count() == df.count()
    assert all(r["auc"] > 0.7 for r in metrics.roc_auc(out, ["location"]).collect())
    assert grouped.fit_logistic(df.limit(0), ["location"]).count() == 0


def test_jobs_do_not_grow_with_groups(spark):
    counts = []
    for groups in (2, 12):
        df = spark.createDataFrame(grouped_rows(3, groups), "location string, variant string, x array<double>, fog int")
        spark.sparkContext.setJobGroup(f"groups-{groups}", "")
        grouped.fit_logistic(df, ["location"], steps=3, tol=0.0).collect()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-{groups}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] > 0 and abs(counts[0] - counts[1]) <= 2


def test_experiments_of_all_locations(spark):
    from hazeline.operators import experiments

    rnd = random.Random(6)
    rows = [(f"l{k % 3}", k % 5 == 0, rnd.random(), rnd.random()) for k in range(900)] + [("small", True, 0.1, 0.1)] * 30
    df = spark.createDataFrame(rows, "location string, late boolean, a double, b double").withColumn("fog", (F.col("a") + F.col("b") / 10 > 0.7).cast("int"))
    for threshold in (0.5, None):
        flat, told = experiments.run_logistic({"both": df, "one": df.drop("b")}, {"both": ["a", "b"], "one": ["a"]}, F.col("late"), threshold=threshold)
        found = {(r["location"], r["variant"], r["metric"]): r["value"] for r in flat.collect()}
        assert len(found) == 3 * 2 * 5 and all(v > 0.9 for k, v in found.items() if k[2] == "auc")
    gains = {(r["location"], r["variant"], r["feature"]): r["importance_pct"] for r in told.collect()}
    assert len(gains) == 9 and gains["l0", "one", "a"] == pytest.approx(100) and gains["l1", "both", "a"] > 70


# --- k-means


def plain_lloyd(x, centers, max_iter):
    for _ in range(max_iter):
        at = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[at == c].mean(axis=0) if (at == c).any() else centers[c] for c in range(len(centers))])
        done = ((new - centers) ** 2).sum(axis=1).max() <= 1e-8
        centers = new
        if done:
            break
    return ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.mark.parametrize("max_iter", [2, 50])
def test_fits_that_move_together_agree_with_single_ones(spark, max_iter):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(300, 4)) + rnd.integers(0, 4, (300, 1)) * 3
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    starts = [cluster.plus_plus(x, k, s) for k in (2, 3, 5) for s in (1, 2)] + [np.full((2, 4), 1e6)]
    for fit, start in zip(cluster.lloyd(df, "v", starts, max_iter), starts, strict=True):
        assert fit.cost == pytest.approx(plain_lloyd(x, start, max_iter))
    got = cluster.lloyd(df, "v", starts[:1])[0]
    assert {r["prediction"] for r in got.transform(df).collect()} == {0, 1}


# --- perceptron


def test_first_layer_of_a_perceptron(spark):
    """A feature that decides the label has the largest weights, wherever it stands."""
    from hazeline.operators import models

    rnd = random.Random(9)
    rows = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(400)]
    for place in (0, 3):
        df = spark.createDataFrame([(r, int(r[place] + r[4 + place] > 0)) for r in rows], "v array<double>, fog int").withColumn("features", models.array_to_vector("v"))
        net = models.sequence_net(df, 8, hidden=(3,), epochs=60)
        assert models.importance(net, ["a", "b", "c", "d"], spark).orderBy(F.desc("importance")).first()["feature"] == "abcd"[place]


def test_models_of_rows_without_positives(spark):
    """Where no train row is positive, every layer of the stack still scores the rows, and none of them high."""
    from hazeline.operators import models

    rows = spark.range(120).select(F.lit("a").alias("location"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("time"), (F.col("id") % 7).cast("double").alias("x"), F.lit(0).alias("fog"))
    fitted = models.logistic(rows, ["x"])
    assert {r["score"] for r in models.scored(fitted, models.assembled(rows, ["x"])).collect()} == {0.0}
    done, _ = models.stack(rows, rows, ["x"], trees=2, rounds=1, epochs=1, length=4)
    found = done.select("p_logistic", "p_forest", "p_boosted", "p_sequence", "score").collect()
    assert len(found) == 116 and all(0 <= v <= 1 for r in found for v in r)
    assert all(r["p_logistic"] == r["p_forest"] == 0 for r in found)


def test_rows_of_the_same_bins_become_one_cell(spark, monkeypatch):
    """All passes but one every few trees go over the cells, whose counts are those of the rows that each tree's sample takes."""
    kept = {}
    spool = boosting.spool
    monkeypatch.setattr(boosting, "spool", lambda df, name: kept.setdefault(name, []).append(spool(df, name)) or kept[name][-1])
    df = spark.range(2000).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") / 2000).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("fog"))
    boosting.fit(df, ["a", "b"], rounds=12, depth=2, bins=4, seed=7)
    rows = kept["binned"][0].toPandas()
    assert len(rows) == 2000 and len(kept["cells"]) == 12 and all(c.count() <= 5 * 5 * 2 for c in kept["cells"])
    for number in (0, 11):
        found = {(bytes(r["bins"]), r["y"]): (r["n_held"], r["n_used"]) for r in kept["cells"][number].selectExpr("bins", "y", "held AS n_held", f"u{number % boosting.REFRESH} AS n_used").collect()}
        rows["used"] = ~rows["held"] & (boosting._mixed(rows["key"].to_numpy(), 7 * 1_000_003 + number) < 0.7)
        want = {(bytes(k[0]), k[1]): (int(p["held"].sum()), int(p["used"].sum())) for k, p in rows.groupby(["bins", "y"])}
        assert found == want


def test_rows_are_packed_by_group(spark, monkeypatch):
    """Blocks hold each row once, of one group each, also where a task gives up waiting for full ones; steps see blocks only."""
    monkeypatch.setattr(grouped, "WAITING", 64)
    rows = [(g, [float(k), float(g)][: 1 + g % 2], float(k % 2)) for k in range(50) for g in range(9)]
    df = spark.createDataFrame(rows, "_g long, _x array<double>, _y double").repartition(3)
    found = []
    for r in grouped._blocks(df).collect():
        x = np.frombuffer(r["_xs"]).reshape(r["_n"], -1)
        found += [(r["_g"], list(a), b) for a, b in zip(x, np.frombuffer(r["_ys"]), strict=True)]
    assert sorted(found) == sorted(rows)


# --- forests


def forest_rows(spark, n, seed=3):
    rnd = np.random.default_rng(seed)
    x = np.stack([rnd.integers(0, 12, n), rnd.integers(0, 30, n), rnd.integers(0, 5, n)], axis=1).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 21) ^ (rnd.random(n) < 0.15)) & (rnd.random(n) < 0.6)
    return spark.createDataFrame([(k, *map(float, r), int(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, fog int")


def test_trees_equal_those_of_spark_where_nothing_is_drawn(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from hazeline.operators import models
    from hazeline.operators.variants import class_weights

    df, cols = forest_rows(spark, 3000), ["a", "b", "c"]
    data = models.assembled(class_weights(df), cols)
    own = RandomForestClassifier(labelCol="fog", weightCol="weight", numTrees=1, maxDepth=6, minInstancesPerNode=25, featureSubsetStrategy="all", bootstrap=False).fit(data)
    model = forest.fit(df, cols, trees=1, depth=6, tried=3, bootstrap=False)
    want = {r["k"]: r["score"] for r in models.scored(own, data).collect()}
    got = {r["k"]: r["score"] for r in models.scored(model, models.assembled(df, cols)).collect()}
    assert len(set(got.values())) > 5 and got == pytest.approx(want, abs=1e-9)
    told = {r["feature"]: r["importance"] for r in models.importance(model, cols, spark).collect()}
    assert [told[c] for c in cols] == pytest.approx(own.featureImportances.toArray().tolist(), abs=1e-9)


def test_a_forest_grows_on_cells_however_rows_are_dealt(spark, monkeypatch):
    """Passes go over rows of the same bins and label as one; the number of tasks, of passes and of copies of cells changes no tree."""
    from hazeline.operators import models

    kept = []
    spool = forest.spool
    monkeypatch.setattr(forest, "spool", lambda df, name: kept.append(spool(df, name)) or kept[-1])
    df, cols = forest_rows(spark, 4000).withColumn("a", F.col("a") + F.col("k") / 1e6), ["a", "b", "c"]
    found = [models.forest(df.repartition(n), cols, trees=5, depth=5).trees for n in (1, 7)]
    monkeypatch.setattr(forest, "COUNTS", 500)
    found.append(models.forest(df, cols, trees=5, depth=5).trees)
    assert found[0] == found[1] == found[2] and len({tuple(t.value) for t in found[0]}) == 5
    monkeypatch.undo()
    small = models.forest(df, ["c"], trees=2, depth=3)
    assert len(small.edges[0]) == 4
    cells = kept[0].toPandas()
    assert cells["n"].sum() == 4000 and not cells.duplicated(["bins", "y"]).any()
    many = df.unionByName(df).unionByName(df)
    monkeypatch.setattr(forest, "spool", lambda df, name: kept.append(spool(df, name)) or kept[-1])
    models.forest(many, cols, trees=5, depth=2)
    assert kept[-1].count() == len(cells) and kept[-1].agg(F.sum("n")).first()[0] == 12000


def test_samples_take_cells_as_often_as_their_rows(spark):
    """A cell of n rows is taken as often as n rows that are each taken Poisson of mean 1; the same key and seed draw the same."""
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    for mean in (1, 5, forest.SMALL, forest.SMALL + 1, 400):
        means = np.full(len(keys), mean)
        got = forest.poisson(means, keys, [9, 10])
        assert (abs(got.mean(axis=1) / mean - 1) < 0.03).all() and (abs(got.var(axis=1) / mean - 1) < 0.06).all()
        assert abs(np.corrcoef(got)[0, 1]) < 0.03 and (got[:, 5:9] == forest.poisson(means[5:9], keys[5:9], [9, 10])).all()
    ones = forest.poisson(np.ones(len(keys), np.int64), keys, [4])[0]
    assert np.bincount(ones)[:4] / len(keys) == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.015)


def test_a_forest_scores_as_one_of_spark(spark):
    """With draws, both find the same: close areas and probabilities; odd tables give forests without splits."""
    from pyspark.ml.classification import RandomForestClassifier

    from hazeline.operators import models
    from hazeline.operators.variants import class_weights

    df, cols = forest_rows(spark, 6000, 8), ["a", "b", "c"]
    train, test = df.where("k % 3 > 0"), models.assembled(df.where("k % 3 = 0"), cols)
    own = RandomForestClassifier(labelCol="fog", weightCol="weight", numTrees=20, maxDepth=10, minInstancesPerNode=25, seed=42).fit(models.assembled(class_weights(train), cols))
    a, b = (models.scored(m, test) for m in (own, models.forest(train, cols)))
    areas = [metrics.roc_auc(d, []).first()["auc"] for d in (a, b)]
    assert min(areas) > 0.7 and abs(areas[0] - areas[1]) < 0.02
    x, y = (np.array([r["score"] for r in d.orderBy("k").collect()]) for d in (a, b))
    assert np.abs(x - y).mean() < 0.05 and np.corrcoef(x, y)[0, 1] > 0.95
    gaps = train.limit(50).withColumn("a", F.lit(None).cast("double"))
    for odd in (train.where("fog = 0"), train.where("fog = 1"), train.limit(0), gaps):
        flat = forest.fit(odd, cols, trees=3)
        assert all(t.feature == [-1] for t in flat.trees)
    assert {v for t in forest.fit(train.where("fog = 1"), cols, trees=2).trees for v in t.value} == {1.0}
    more = forest.fit(train.unionByName(gaps), cols, trees=2)
    assert [t.feature[0] >= 0 for t in more.trees] == [True, True]


def test_few_cells_in_the_driver_give_the_same_trees(spark, monkeypatch):
    """Where all rows are used, trees grown from cells that the driver holds are those that Spark's sums give."""
    rnd = np.random.default_rng(8)
    x = np.stack([rnd.integers(0, 12, 600), rnd.integers(0, 30, 600)], axis=1).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(a + b / 3 + rnd.normal(0, 2) > 11)) for a, b in x], "a double, b double, fog int")
    fits = []
    for long in (100, 5):
        monkeypatch.setattr(boosting, "LONG", long)
        fits.append(boosting.fit(df, ["a", "b"], rounds=7, depth=3, step=0.3, rows_used=1.0, seed=4))
    one, two = fits
    assert [(t.feature, t.bin, t.missing_left) for t in one.trees] == [(t.feature, t.bin, t.missing_left) for t in two.trees]
    assert np.allclose([v for t in one.trees for v in t.value], [v for t in two.trees for v in t.value]) and np.allclose(one.history, two.history)


def test_boosting_query_takes_the_published_rounds(spark, monkeypatch):
    from hazeline.plans import catalogue

    asked = []

    def fit(train, cols, label, rounds, depth, step, patience=20, seed=42):
        asked.append((rounds, depth, step, patience))
        return boosting.Boosted(tuple(cols), [np.zeros(0)] * len(cols), [], [])

    monkeypatch.setattr(boosting, "fit", fit)
    catalogue.queries()["model_gbt"](spark, "/root/testdata/sf0.001")
    assert asked == [(10_000, 5, 0.05, 1_000)]


def test_stacking_takes_the_published_sizes(spark, monkeypatch):
    from hazeline.operators import models
    from hazeline.plans import catalogue

    class Asked(Exception):
        pass

    asked = {}

    def forest(train, cols, label="fog", trees=0, **more):
        asked["trees"] = trees
        return boosting.Boosted(tuple(cols), [np.zeros(0)] * len(cols), [], [])

    def boosted(train, cols, label="fog", rounds=0, patience=0, **more):
        asked.update(rounds=rounds, patience=patience)
        return boosting.Boosted(tuple(cols), [np.zeros(0)] * len(cols), [], [])

    def network(*args, epochs=0, **more):
        asked["epochs"] = epochs
        raise Asked

    monkeypatch.setattr(models, "forest", forest)
    monkeypatch.setattr(models, "boosted", boosted)
    monkeypatch.setattr(convolution, "fit", network)
    with pytest.raises(Asked):
        catalogue.queries()["model_stacking"](spark, "/root/testdata/sf0.001")
    assert asked == {"trees": 500, "rounds": 10_000, "patience": 1_000, "epochs": 50}
