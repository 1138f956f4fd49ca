"""Small fixtures for the semantic traps of the domain."""

import datetime as dt
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline import schema
from hazeline.functions import scalar as fn
from hazeline.operators import asof, clean, cluster, features, metrics, positions, quantiles, stats, variants
from hazeline.sources import archive, files, named, report
from hazeline.streaming import hourly, series


def t(text):
    return dt.datetime.fromisoformat(f"2024-01-{text}")


def hours(spark, n, start="01 00:00", **cols):
    rows = [(k, t(start) + dt.timedelta(hours=i), *(c(i) for c in cols.values())) for k in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "location string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))


def test_parse_visibility(spark):
    df = spark.createDataFrame([("016093,5,N,5",), ("x,1",), (None,), ("",), ("7",)], "v string")
    assert [r[0] for r in df.select(fn.parse_visibility(F.col("v"))).collect()] == [16093, None, None, None, 7]


def test_labels(spark):
    df = spark.createDataFrame([(1000.0,), (1001.0,), (1609.0,), (1610.0,), (None,)], "v double")
    assert [tuple(r) for r in df.select(fn.fog_binary(F.col("v")), fn.fog_label(F.col("v"))).collect()] == [(1, 1), (0, 1), (0, 1), (0, 0), (-9999, 0)]


def test_round_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (0.125, 0.375, 1.005, 2.675, -0.125)], "v double")
    assert [r[0] for r in df.select(fn.round_half_even(F.col("v"))).collect()] == [0.12, 0.38, 1.0, 2.68, -0.12]


def test_year_range_reaches_the_scan(spark, tmp_path):
    hours(spark, 5, x=float).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x")).where(fn.not_in_year(F.col("time"), 2023))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(time" in plan and df.count() == 10


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(100.0, 1.0), (200.0, None), (400.0, 4.0), (999999.0, None)], "visibility double, x double")
    out = clean.impute_median(clean.replace_with_median(df, "visibility"), ["x"])
    assert sorted(tuple(r) for r in out.collect()) == [(100.0, 1.0), (200.0, 2.5), (200.0, 2.5), (400.0, 4.0)]


@pytest.mark.parametrize("whole", [20_000, 0])
def test_quantiles_agree_with_numpy(spark, monkeypatch, whole):
    """Large groups are bracketed by a sketch: here those of 30,000, and then all of over 2 values."""
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    monkeypatch.setattr(quantiles, "MARGIN", 5 / quantiles.ACCURACY if whole else 0.3)
    rng = np.random.default_rng(whole)
    inf, nan = float("inf"), float("nan")
    groups = {
        "spread": rng.standard_normal(501).tolist(), "large": (rng.integers(0, 10**6, 30_000) / 7).tolist(), "few": rng.integers(0, 9, 30_000).astype(float).tolist(), "ties": [1.0] * 50 + [2.0] * 51 + [7.5] * 3, "one": [4.25], "same": [3.0] * 9, "wide": [-1e308, 1e308, 0.0, 5e-324],
        "far": [999999.0, *rng.random(40).tolist()], "ends": [inf, -inf, 1.0, 2.0, 3.0], None: [1.0, None, 2.0, nan], "none": [None, None],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, value double")
    got = {r["g"]: r["_q"] for r in quantiles.summarised(df, ["g"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got.keys() == groups.keys() and got["none"] == [None] * 5
    for g, xs in groups.items():
        xs = sorted(x for x in xs if x is not None and x == x)
        for p, q in zip([0.0, 0.25, 0.5, 0.9, 1.0], got[g], strict=True):
            if xs:
                at = p * (len(xs) - 1)
                low, high = xs[int(np.floor(at))], xs[int(np.ceil(at))]
                want = low if low == high else low + (high - low) * (at - float(np.floor(at)))
                assert q == want or abs(q - want) <= 1e-12 * max(1, abs(q)), (g, p)
    assert quantiles.summarised(df.limit(0), ["g"], [0.5]).count() == 0
    assert {r["g"]: r["value"] for r in quantiles.medians(df, ["value"], ["g"]).collect()}["ties"] == 2.0


def test_brackets_of_giant_groups_are_cut_again(spark, monkeypatch):
    """With lowered bounds brackets hold 60 % of a group: three rounds until no window takes over 40 values, the same quantiles."""
    ps = [0.0, 0.3, 0.5, 1.0]
    monkeypatch.setattr(quantiles, "WHOLE", 10)
    monkeypatch.setattr(quantiles, "MARGIN", 0.3)
    monkeypatch.setattr(quantiles, "HELD", 40)
    monkeypatch.setattr(quantiles, "SEGMENTS", 2)
    held = []
    cut, narrowed = quantiles._cut, quantiles._narrowed
    monkeypatch.setattr(quantiles, "_cut", lambda counts, *rest: held.append(counts.count()) or cut(counts, *rest))
    left = []
    monkeypatch.setattr(quantiles, "_narrowed", lambda *args: left.append(narrowed(*args)) or left[0])
    rng = np.random.default_rng(3)
    groups = {
        "spread": rng.standard_normal(9000).tolist(), "tied": [*([5.0] * 4000), *rng.random(2000).tolist(), *(6 + rng.random(2000)).tolist()],
        "ends": [float("-inf")] * 30 + rng.random(300).tolist() + [float("inf")] * 30, "few": [1.0, 2.0], None: [4.0, None, float("nan")], "none": [None],
    }
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, value double")
    got = {r["g"]: r["_q"] for r in quantiles.summarised(df, ["g"], ps).collect()}
    assert len(held) >= 3 and held == sorted(held, reverse=True)
    assert left[0].groupBy("_k").agg(F.count("_w").alias("n")).agg(F.max("n")).first()[0] <= 40
    assert left[0].agg(F.sum("_n")).first()[0] == sum(x is not None and x == x for xs in groups.values() for x in xs)
    assert got.keys() == groups.keys() and got["none"] == [None] * 4
    for g, xs in groups.items():
        xs = sorted(x for x in xs if x is not None and x == x)
        for p, q in zip(ps, got[g] if xs else (), strict=bool(xs)):
            low, high = xs[int(np.floor(p * (len(xs) - 1)))], xs[int(np.ceil(p * (len(xs) - 1)))]
            want = low if low == high else low + (high - low) * (p * (len(xs) - 1) % 1)
            assert q == want or abs(q - want) <= 1e-12, (g, p)


def test_describe_rollup_reads_its_input_once(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, None), (None, 1, 6.0)], "location string, year int, x double")
    out = {(r["location"], r["year"]): r for r in stats.describe_rollup(df, ["x"], ["location", "year"]).collect()}
    assert out["a", None]["n"] == 2 and out["a", None]["median"] == 3.0 and abs(out["a", 1]["std"] - 2**0.5) < 1e-12 and out["a", 2]["no_data"]
    assert out["a", 2]["median"] is None and len(out) == 5


def test_lags_are_null_at_the_start_and_survive_blocks(spark, monkeypatch):
    df = hours(spark, 100, temperature_2m=lambda i: float(i * i % 37))
    want = sorted(tuple(r) for r in features.cooling_rates(df).collect())
    monkeypatch.setattr(positions, "BLOCK", 16)
    got = sorted(tuple(r) for r in features.cooling_rates(df).collect())
    # nulls sort apart from numbers
    assert str(got) == str(want)
    one = [r for r in got if r[0] == "a"]
    assert [r[3] is None for r in one[:7]] == [True] * 6 + [False] and [r[4] is None for r in one[11:13]] == [True, False]
    assert one[20][3] == (one[20][2] - one[14][2]) / 6


def test_previous_night_low(spark):
    df = hours(spark, 72, x=lambda i: float((i * 7) % 24))
    out = [r for r in features.previous_night_low(df, "x").orderBy("location", "time").collect() if r["location"] == "a"]
    values = [r["x"] for r in out]
    assert all(r["previous_night_low"] is None for r in out[:24])
    assert {r["previous_night_low"] for r in out[24:48]} == {min(values[18:30])}


def test_sequences(spark):
    df = hours(spark, 30, x=float)
    out = features.sequences(df, ["x"]).where("location = 'a'").orderBy("time").collect()
    assert len(out) == 6 and [s["x"] for s in out[0]["sequence"]] == [float(i) for i in range(24)]
    gap = df.where("not (location = 'a' and hour(time) = 3 and day(time) = 2)")
    assert features.sequences(gap, ["x"], max_gap_hours=1).where("location = 'a'").count() == 3
    assert features.after_first(df).count() == 12
    assert features.last_fraction(df).where("is_validation").count() == 12


LEFT = [t("01 10:00"), t("01 11:00"), t("01 12:00"), t("01 20:00")]
RIGHT = [(t("01 09:30"), "back30"), (t("01 10:30"), "fwd30"), (t("01 12:00"), "dupA"), (t("01 12:00"), "dupB"), (t("01 20:30") + dt.timedelta(seconds=1), "far")]


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("x", a) for a in LEFT], "location string, time timestamp_ntz")
    right = spark.createDataFrame([("x", a, i, v) for i, (a, v) in enumerate(RIGHT)], "location string, time timestamp_ntz, seq int, v string")
    back = asof.nearest(left, right, ["v"], 30, order=["seq"]).orderBy("time").collect()
    assert [r["v"] for r in back] == ["back30", "fwd30", "dupB", None] and [r["diff_minutes"] for r in back] == [30.0, 30.0, 0.0, None]
    first = asof.nearest(left, right, ["v"], 120, order=["seq"], tie=asof.FIRST).orderBy("time").collect()
    assert [r["v"] for r in first] == ["back30", "fwd30", "dupA", "far"]
    kinds = {r["kind"]: r["n"] for r in asof.match_kinds(asof.nearest(left, right, ["v"], 30, order=["seq"])).collect()}
    assert kinds == {"exact": 1, "approximate": 2, "none": 1}


def test_asof_agrees_with_pandas_across_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-01-01")
    lt = base + pd.to_timedelta(np.sort(rng.integers(0, 200_000, 300)), unit="s")
    rt = base + pd.to_timedelta(np.sort(rng.integers(0, 200_000, 150)), unit="s")
    l, r = pd.DataFrame({"time": lt}), pd.DataFrame({"time": rt, "v": np.arange(150.0)})
    want = pd.merge_asof(l, r, on="time", direction="nearest", tolerance=pd.Timedelta("10min"))
    left = spark.createDataFrame([("x", a.to_pydatetime()) for a in lt], "location string, time timestamp_ntz")
    right = spark.createDataFrame([("x", a.to_pydatetime(), float(i)) for i, a in enumerate(rt)], "location string, time timestamp_ntz, v double")
    got = asof.nearest(left, right, ["v"], 10, order=["v"], bucket_hours=1).toPandas().sort_values("time")
    assert sorted(got["v"].fillna(-1)) == sorted(want["v"].fillna(-1))


@pytest.mark.parametrize(("by", "tie"), [(("k",), asof.BACKWARD), (("k",), asof.FIRST), ((), asof.BACKWARD), ((), asof.FIRST)])
def test_asof_blocks_agree_with_buckets(spark, monkeypatch, by, tie):
    """Hot times on both sides, repeated rows, null keys and times: blocks give the rows that buckets give, and no block holds most of them."""
    rng = np.random.default_rng(5)
    at = lambda n, hot: [None if x < 0.02 else t("01 03:00") if x < hot else t("01 00:00") + dt.timedelta(seconds=int(x * 20_000)) for x in rng.random(n)]
    keys = lambda n: [None if x < 0.1 else "hot" if x < 0.7 else "b" for x in rng.random(n)]
    left = spark.createDataFrame([*zip(keys(900), at(900, 0.4), [i // 2 for i in range(900)], strict=True)], "k string, time timestamp_ntz, i int")
    left = left.unionByName(left.limit(300))
    right = spark.createDataFrame([*zip(keys(300), at(300, 0.3), range(300), strict=True)], "k string, seen timestamp_ntz, seq int")

    def rows():
        return sorted(map(str, asof.nearest(left, right, ["seq"], 3, by=by, right_on="seen", tie=tie, order=["seq"], bucket_hours=1).collect()))

    want = rows()
    sizes = []
    spool = asof.spool
    monkeypatch.setattr(asof, "BUCKET_ROWS", 50)
    monkeypatch.setattr(asof, "spool", lambda df, name: sizes.append(spool(df, name)) or sizes[-1])
    assert rows() == want and len(want) == 1200
    blocks = [r["count"] for r in sizes[0].groupBy("_block").count().collect()]
    assert len(blocks) == 4 and max(blocks) < 0.4 * sum(blocks)
    empty = right.limit(0)
    assert asof.nearest(left, empty, ["seq"], 3, by=by, right_on="seen", tie=tie, order=["seq"]).where("seq IS NULL").count() == 1200


def test_variants_and_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None), ("b", 3.0, 1.0)], "location string, x double, pm10 double")
    parts = variants.variants(df, ["pm10"])
    assert {k: (v.count(), v.columns) for k, v in parts.items()} == {
        "without_aqi": (3, ["location", "x"]), "with_aqi": (2, ["location", "x", "pm10"]), "without_aqi_reduced": (2, ["location", "x"]),
    }
    assert variants.complete(variants.stacked(parts)).select("location").distinct().count() == 2
    assert variants.large_enough(df, F.col("x") > 1.5, ["location"], 1, 1).select("location").distinct().collect()[0][0] == "a"


def test_combine_and_append(spark):
    cols = {c: float for c in (*schema.WEATHER, "weather_code", "cloud_cover_low")}
    weather = features.append_inferred(hours(spark, 30, **cols))
    air = hours(spark, 30, start="01 05:00", **dict.fromkeys(schema.AIR, float))
    reports = spark.createDataFrame([("a", t("01 06:20"), "000800,1"), ("a", t("01 09:00"), None)], "location string, DATE timestamp_ntz, VIS string")
    out = variants.combine(weather, air, reports)
    rows = out.collect()
    assert len(out.columns) == 1 + 26 and [(r["time"], r["visibility_meters"]) for r in rows] == [(t("01 06:00"), 800.0)]


def test_correlation_skips_missing_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None), ("a", 3.0, 5.0), ("a", 4.0, 5.5), ("a", None, 1.0)], "location string, x double, y double")
    assert stats.correlations(df, ["x"], "y").first()["r"] == pytest.approx(0.9798637100971994, abs=1e-12)


def test_sweep_ties_defaults_and_auc(spark):
    none = spark.createDataFrame([("a", 0.01, 1), ("a", 0.02, 0)], "g string, score double, fog int")
    assert metrics.best_threshold(metrics.sweep(none)).first()["threshold"] == 0.5
    tied = spark.createDataFrame([("a", 0.9, 1), ("a", 0.05, 0)], "g string, score double, fog int")
    assert metrics.best_threshold(metrics.sweep(tied)).first()["threshold"] == 0.1
    assert len(metrics.THRESHOLDS) == 10 and metrics.THRESHOLDS[1] == 0.15000000000000002
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.7, 1), ("a", 0.1, 0), ("b", 0.3, 1)], "g string, score double, fog int")
    assert {r["g"]: r["auc"] for r in metrics.roc_auc(df, ["g"]).collect()} == {"a": 0.875, "b": 0.0}


def test_empty_tables_give_empty_results(spark):
    df = spark.createDataFrame([], "location string, time timestamp_ntz, temperature_2m double, dew_point_2m double")
    assert features.append_inferred(df).count() == 0
    assert asof.nearest(df, df.select("location", "time", F.col("dew_point_2m").alias("v")), ["v"], 30).count() == 0
    assert stats.describe(df, ["temperature_2m"]).count() == 0


def test_describe_marks_missing_data(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "x double, y double")
    rows = {r["feature"]: r for r in stats.describe(df, ["x", "y"]).collect()}
    assert rows["x"]["no_data"] and rows["x"]["n"] == 0 and rows["y"]["median"] == 2.0


def test_kmeans_queries_run_the_whole_job(spark, monkeypatch):
    from hazeline.operators import cluster
    from hazeline.plans import catalogue

    calls = []

    class Fitted:
        def __init__(self, cost):
            self.cost = cost

        def transform(self, df):
            return df.selectExpr("*", "0 AS prediction")

    def fake(df, features, ks, restarts, seed, max_iter):
        calls.append((ks, restarts, max_iter))
        # the rate of decrease falls most at 12
        return {k: Fitted(1e6 * 0.5 ** min(k, 11) * 0.99 ** max(0, k - 11)) for k in ks}

    monkeypatch.setattr(cluster, "_least", fake)
    monkeypatch.setattr(catalogue.views, "table", lambda spark, d, name: spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    queries = catalogue.queries()
    assert queries["kmeans_elbow"](spark, "").first()["k"] == 12
    assert calls == [([*range(3, 21)], 10, 50)]
    calls.clear()
    queries["kmeans_best_of_n"](spark, "").collect()
    assert calls == [([8], 10, 50)]


def test_kmeans_keeps_the_best_of_its_restarts(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(float(x + dx), float(dx)) for x in (0, 50, 90, 300) for dx in range(5)]
    df = spark.createDataFrame(rows, "x double, y double").select(array_to_vector(F.array("x", "y")).alias("features"))
    model, cost = cluster.kmeans(df, "features", k=4, restarts=5)
    assert len(model.clusterCenters()) == 4 and abs(cost - 4 * 2 * 10) < 1e-9
    assert [r["k"] for r in cluster.elbow_scan(df, "features", range(2, 5), restarts=2).orderBy("k").collect()] == [2, 3, 4]


def test_elbow(spark):
    df = spark.createDataFrame([(3, 900.0), (4, 700.0), (5, 560.0), (6, 480.0)], "k int, inertia double")
    rates = [200 / 900, 140 / 700, 80 / 560]
    want = 3 + max(range(1, 3), key=lambda i: rates[i - 1] - rates[i]) + 1
    assert stats.elbow(df).first()["k"] == want


def test_silhouette_of_single_rows_is_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [9.0, 9.0], 2)], "vec_id long, embedding array<double>, label int")
    got = cluster.silhouette(df).first()["silhouette"]
    b = [162**0.5, (81 + 64) ** 0.5]
    assert got == pytest.approx(sum((x - 1) / x for x in b) / 3)


def test_csv_round_trip_by_location(spark, tmp_path):
    df = hours(spark, 4, pm10=lambda i: None if i == 2 else i / 4)
    for k in ("6", "7"):
        df.where("location = 'a'").drop("location").coalesce(1).write.option("header", True).option("timestampNTZFormat", files.TIME_FORMAT).csv(str(tmp_path / k))
        next((tmp_path / k).glob("part-*.csv")).rename(tmp_path / f"location_{k}_aqi.csv")
    layer = schema.AIR_LAYER[:3]
    got = files.read_located(spark, f"{tmp_path}/location_*_aqi.csv", layer)
    assert sorted(r[0] for r in got.select("location").distinct().collect()) == ["6", "7"]
    assert sorted(r["pm10"] for r in got.where("location = '6' and pm10 is not null").collect()) == [0.0, 0.25, 0.75]
    files.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 8
    files.fan_out({"x": df, "y": df.where("location = 'a'")}, str(tmp_path / "fan"), df)
    assert spark.read.parquet(str(tmp_path / "fan/y")).count() == 4
    assert files.locations_with_all([df, df.where("location = 'b'")]).collect()[0][0] == "b"


def test_named_files(spark, tmp_path):
    df = hours(spark, 30, x=lambda i: None if i == 3 else float(i), y=float).repartition(5)
    there = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    out = str(tmp_path / "out")
    named.write_named(df, out, "location_{location}_aqi.csv")
    assert there() == ["_SUCCESS", "location_a_aqi.csv", "location_b_aqi.csv"]
    layer = df.drop("location").schema
    got = files.read_located(spark, f"{out}/location_*_aqi.csv", layer)
    assert sorted(map(tuple, got.select(*df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    lines = (tmp_path / "out" / "location_a_aqi.csv").read_text().splitlines()
    assert lines[0] == '"time","x","y"' and lines[1:] == sorted(lines[1:]) and lines[4] == '"2024-01-01 03:00:00",,3' and len(lines) == 31

    named.write_named(df, f"file://{out}", "location_{location}_{n}.csv", 13)
    assert there() == ["_SUCCESS", *(f"location_{k}_{n}.csv" for k in "ab" for n in (0, 1, 2))]
    assert [len((tmp_path / "out" / f"location_b_{n}.csv").read_text().splitlines()) for n in (0, 1, 2)] == [14, 14, 5]
    with pytest.raises(ValueError, match="goes with rows"):
        named.write_named(df, out, "location_{location}_{n}.csv")


def test_named_files_of_a_failed_job_are_not_there(spark, tmp_path):
    df, out = hours(spark, 30, x=float), tmp_path / "out"
    named.write_named(df.where("location = 'a'"), str(out), "{location}.csv")
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    failing = df.withColumn("x", F.when(F.expr("location = 'b' and x = 29"), F.raise_error(F.lit("no more"))).otherwise(F.col("x")).cast("double"))
    spark.dataSource.register(named.NamedFiles)
    write = lambda rows: rows.write.format("named_files").option("file", "location").mode("append").save(str(out))
    for job, why in (
        (lambda: named.write_named(failing, str(out), "{location}.csv"), "no more"),
        (lambda: named.write_named(df, str(out), "{location}.csv", overwrite=False), "there already"),
        (lambda: named.write_named(df.withColumn("location", F.lit("x/y")), str(out), "{location}.csv"), "can't name"),
        (lambda: named.write_named(df.withColumn("location", F.lit(None).cast("string")), str(out), "{location}.csv"), "can't name"),
        (lambda: write(df.withColumn("location", F.lit("c")).repartition(3, "x")), "several tasks"),
        (lambda: write(df.orderBy("x").coalesce(1)), "side by side"),
    ):
        with pytest.raises(Exception, match=why):
            job()
        assert {p.name: p.read_bytes() for p in out.iterdir()} == before


def test_archive_answers(spark):
    body = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm10": [1.5, null]}}'
    df = spark.createDataFrame([("x", body), ("y", '{"hourly": {}}')], "location string, body string")
    rows = archive.hourly_rows(df, ["pm10", "dust"]).orderBy("time").collect()
    assert [tuple(r) for r in rows] == [("x", t("01 00:00"), 1.5, None), ("x", t("01 01:00"), None, None)]
    reader = lambda tasks: archive.ArchiveReader(schema.AIR_LAYER, {"years": "2020-2021", "places": "a:1:2;b:3:4", "tasks": tasks})
    assert [[r[0] + str(r[3]) for r in p.requests] for p in reader("1").partitions()] == [["a2020", "a2021", "b2020", "b2021"]]
    assert [[r[0] + str(r[3]) for r in p.requests] for p in reader("9").partitions()] == [["a2020"], ["a2021"], ["b2020"], ["b2021"]]


#: What the server of a test was asked for: (latitude, year).
ASKED: dict[str, list] = {}


@pytest.fixture
def server():
    """An archive that answers like the real one, fails for 2021 and answers no JSON for 2022."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            year = asked["start_date"][:4]
            found.asked.append((asked["latitude"], int(year)))
            self.send_response(500 if year == "2021" else 200)
            self.end_headers()
            hours = {"time": [f"{year}-01-01T00:00", f"{year}-01-01T01:00"], "pm10": [float(asked["latitude"]), None]}
            self.wfile.write(b"no json" if year == "2022" else json.dumps({} if year == "2023" else {"hourly": hours}).encode())

        def log_message(self, *_):
            pass

    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    found.asked = []
    threading.Thread(target=found.serve_forever, daemon=True).start()
    ASKED["requests"] = found.asked
    yield f"http://127.0.0.1:{found.server_port}/archive"
    found.shutdown()


def test_archive_source(spark, server):
    spark.dataSource.register(archive.HourlyArchive)
    kind = "location string, time timestamp_ntz, pm10 double, dust double"
    options = {"url": server, "places": "a:1.5:2;b:3:4", "pause": "0", "tasks": "2"}
    rows = lambda years, **more: spark.read.format("hourly_archive").schema(kind).options(**options, years=years, **more).load()
    found = sorted(tuple(r) for r in rows("2019-2023").collect())
    at = [dt.datetime(y, 1, 1, h) for y in (2019, 2020) for h in (0, 1)]
    assert found == [(x, w, v if w.hour == 0 else None, None) for x, v in (("a", 1.5), ("b", 3.0)) for w in at]
    assert rows("2023").count() == 0 and rows("2023").schema == rows("2019").schema
    for year in ("2021", "2022"):
        with pytest.raises(Exception, match="HTTP Error 500|Expecting value"):
            rows(year, on_error="fail").collect()


def test_archive_source_asks_only_for_what_filters_let_through(spark, server):
    spark.dataSource.register(archive.HourlyArchive)
    options = {"url": server, "places": "a:1:2;b:3:4;c:5:6", "pause": "0", "years": "2014-2020", "pushdown": "true"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        df = spark.read.format("hourly_archive").schema("location string, time timestamp_ntz, pm10 double").options(**options).load()

        def asked(where):
            ASKED["requests"].clear()
            rows = [(r["location"], r["time"].year) for r in df.where(where).where("hour(time) = 0").collect()]
            return sorted(ASKED["requests"]), sorted(rows)

        between = "time >= timestamp_ntz'2016-05-01' AND time < timestamp_ntz'2019-01-01'"
        assert asked(f"location = 'b' AND {between}") == ([("3", y) for y in (2016, 2017, 2018)], [("b", 2017), ("b", 2018)])
        assert asked("location IN ('a', 'c') AND time = timestamp_ntz'2015-01-01'") == ([("1", 2015), ("5", 2015)], [("a", 2015), ("c", 2015)])
        assert asked("location = 'a' AND time > timestamp_ntz'2019-12-31' AND time <= timestamp_ntz'2020-01-01'") == ([("1", 2019), ("1", 2020)], [("a", 2020)])
        assert asked("location = 'nowhere'") == ([], []) and len(asked("pm10 > 0")[0]) == 21
        assert asked("location = 'a' AND location = 'b'") == ([], [])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_archive_source_gives_failed_years_as_rows(spark, server):
    spark.dataSource.register(archive.HourlyArchive)
    options = {"url": server, "places": "a:1:2", "pause": "0", "years": "2020-2023", "retries": "2"}
    df = spark.read.format("hourly_archive").schema("error string, location string, time timestamp_ntz, pm10 double").options(**options).load()
    ASKED["requests"].clear()
    rows = sorted((r["time"], r["location"], r["pm10"], r["error"] and r["error"].split(":")[0]) for r in df.where("hour(time) = 0").collect())
    first = [dt.datetime(y, 1, 1) for y in (2020, 2021, 2022)]
    assert rows == [(first[0], "a", 1.0, None), (first[1], "a", None, "HTTPError"), (first[2], "a", None, "JSONDecodeError")]
    assert [y for _, y in ASKED["requests"]] == [2020, *[2021] * 3, *[2022] * 3, 2023]


def test_archive_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    spark.dataSource.register(archive.HourlyArchive)
    kind = "error string, location string, time timestamp_ntz, pm10 double"
    options = {"url": server, "places": "a:1:2;b:3:4", "pause": "0", "years": "2018-2022", "state": str(tmp_path / "state"), "per_batch": "3", "again": "1", "tasks": "2"}

    def run(**more):
        ASKED["requests"].clear()
        df = spark.readStream.format("hourly_archive").schema(kind).options(**options | more).load()
        stream = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        stream.trigger(availableNow=True).start().awaitTermination(120)
        return sorted((int(p), y) for p, y in ASKED["requests"])

    assert run() == [(1, 2018), (1, 2019), (3, 2018)]  # three requests of ten, then the query stops
    assert run() == [(1, 2020), (3, 2019), (3, 2020)]
    assert run(per_batch="0") == sorted([(p, y) for p in (1, 3) for y in (2021, 2022)] * 2)  # two years fail, also in the second round
    assert run(per_batch="0") == []
    rows = [(r["location"], r["time"].year, r["error"] is None) for r in spark.read.parquet(str(tmp_path / "out")).where("hour(time) = 0").collect()]
    assert sorted(rows) == sorted([(x, y, True) for x in "ab" for y in (2018, 2019, 2020)] + [(x, y, False) for x in "ab" for y in (2021, 2022)] * 2)
    with pytest.raises(Exception, match="other requests"):
        run(years="2018-2023")


def test_archive_stream_keeps_answers_within_a_batch(server, tmp_path):
    """A batch that is planned again asks only for what has not been answered; a year that fails once is had in the next round."""
    from pyspark.sql.types import _parse_datatype_string as parsed

    kind = parsed("error string, location string, time timestamp_ntz, pm10 double")
    reader = lambda: archive.ArchiveStream(kind, {"url": server, "places": "a:1:2", "pause": "0", "years": "2019-2021", "state": f"file://{tmp_path}/state", "again": "2"})
    first = reader()
    start, end = first.initialOffset(), first.latestOffset()
    (part,) = first.partitions(start, end)
    ASKED["requests"].clear()
    reading = first.read(part)
    assert [next(reading).num_rows, next(reading).num_rows] == [2, 2]  # then the task is lost
    again = reader()
    assert again.latestOffset() == end == {"given": 9}
    again.archive.fetch = lambda *_, keep=again.archive.fetch, failed=[]: keep("1", "2", 2020) if failed else failed.append(1) or keep("1", "2", 2021)  # noqa: B006
    found = [b.to_pylist() for b in again.read(part)]
    assert [y for _, y in ASKED["requests"]] == [2019, 2020, 2021, 2020]
    assert [(len(b), b[0]["error"] is None) for b in found] == [(2, True), (2, True), (1, False), (2, True)]


def test_counters_while_writing(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: passed.add(1) or x, "long").asNondeterministic()
    df = spark.range(1000).select(seen("id").alias("x"))
    write = lambda path: lambda rows: rows.write.parquet(str(tmp_path / path))
    assert report.counted(df, write("all"), even=F.col("x") % 2 == 0, none=F.col("x").isNull()) == {"rows": 1000, "even": 500, "none": 0}
    assert passed.value == 1000 and spark.read.parquet(str(tmp_path / "all")).count() == 1000
    assert report.counted(df.where("x < 0"), write("none"), even=F.col("x") % 2 == 0) == {"rows": 0, "even": 0}


def test_reports(spark, tmp_path):
    m = spark.createDataFrame([("location_6", "with_aqi", "forest", "test", "f1", 0.28161)], schema.METRICS)
    report.write_metrics(m, str(tmp_path / "m"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines[0] == "Location 6 - with_aqi (forest)" and lines[1].endswith("      0.2816")
    assert lines[2] == "forest over 1 locations" and lines[3].split() == ["f1", "with_aqi", "0.2816", "+0.0000"]
    labelled = spark.createDataFrame([("location_6", 1), ("location_6", 0)], "location string, fog int")
    report.write_metrics(m, str(tmp_path / "all"), labelled, spark.createDataFrame([("location_6", 0.35, 0.5)], "location string, threshold double, f1 double"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "all")).collect()]
    assert [x.split() for x in lines[:4]] == [["Class", "balance"], ["Location", "6", "2", "1", "50.00%"], ["Thresholds"], ["Location", "6", "0.35", "0.5000"]]
    i = spark.createDataFrame([("location_6", "with_aqi", "forest", "x", 1.0, 25.0), ("location_6", "with_aqi", "forest", "y", 3.0, 75.0)], schema.IMPORTANCE)
    report.write_importance(i, str(tmp_path / "i"))
    assert [r[0].split()[0] for r in spark.read.text(str(tmp_path / "i")).collect()][1:] == ["y", "x"]


def test_streaming_agrees_with_batch(spark, tmp_path):
    rows = [(t("01 00:10"), "a", 1.0), (t("01 00:50"), "a", 3.0), (t("01 01:10"), "b", 5.0), (t("02 00:00"), "a", 9.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = hourly.start(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in hourly.hourly(df).collect()}
    assert got and got <= want and len(want - got) <= 1  # the last hour stays open


def test_hours_of_a_stream_are_replaced_by_later_batches(spark, tmp_path):
    kind = "ts timestamp_ntz, event_type string, value double"
    every = [[(t("01 00:10"), "a", 1.0), (t("01 01:10"), "b", 5.0)], [(t("01 00:50"), "a", 3.0), (t("01 02:00"), "a", 9.0)]]
    for rows in every:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        hourly.start_updates(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted(tuple(r) for r in hourly.latest(spark, str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in hourly.hourly(spark.createDataFrame(every[0] + every[1], kind)).collect()) and len(got) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4  # the second batch wrote its two hours only


def test_lags_and_night_lows_of_a_stream_agree_with_those_of_the_series(spark, tmp_path):
    """Three stretches of days, each with rows of the one before that come late, gaps, nulls, NaN and a day without a morning."""
    rng = np.random.default_rng(5)
    temps = lambda i: None if i % 17 == 3 else float("nan") if i % 31 == 7 else float(rng.integers(0, 40))
    rows = [(k, t("01 00:00") + dt.timedelta(hours=i), temps(i)) for k in ("a", "b", None) for i in range(24 * 9) if i % 13 != 4 and not (k == "a" and 72 <= i < 81)]
    hour = lambda r: int((r[1] - t("01 00:00")).total_seconds()) // 3600
    kind = "location string, time timestamp_ntz, temp double"
    # a third of the last day's rows of a stretch come with the next one, at most 30 hours late
    batch = lambda r: min(2, hour(r) // 72 + (hour(r) % 72 >= 60 and hour(r) % 3 == 0))
    for b in range(3):
        part = [r for r in rows if batch(r) == b]
        spark.createDataFrame([part[i] for i in rng.permutation(len(part))], kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        series.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), lateness="30 hours").awaitTermination(200)
        if b == 0:
            assert 0 < spark.read.parquet(str(tmp_path / "out")).count() < len(part)
    whole = spark.createDataFrame(rows, kind)
    want = features.previous_night_low(features.cooling_rates(whole, (6, 12), "temp"), "temp")
    names = ["location", "time", "temp", "cooling_rate_6h", "cooling_rate_12h", "previous_night_low"]
    shown = lambda df: sorted(map(repr, df.select("location", F.col("time").cast("timestamp_ntz").alias("time"), *names[2:]).collect()))
    mark = max(r[1] for r in rows) - dt.timedelta(hours=30)
    due = F.when(F.hour("time") < 6, F.date_trunc("day", "time") + F.expr("interval 6 hours")).otherwise(F.col("time"))
    got = shown(spark.read.parquet(str(tmp_path / "out")))
    assert got == shown(want.where(due <= F.lit(mark))) and len(got) > 450


def test_models_find_a_signal(spark):
    from hazeline.operators import models

    df = spark.range(600).select((F.col("id") % 20).cast("double").alias("x"), (F.xxhash64("id") % 7).cast("double").alias("y")).withColumn("fog", (F.col("x") > 15).cast("int"))
    fitted = models.logistic(features.standardize(df, ["x", "y"]), ["x", "y"], max_iter=30)
    out = models.scored(fitted, models.assembled(features.standardize(df, ["x", "y"]), ["x", "y"]))
    assert metrics.roc_auc(out).first()["auc"] > 0.95
    imp = {r["feature"]: r["importance_pct"] for r in models.importance(fitted, ["x", "y"], spark).collect()}
    assert imp["x"] > 80 and sum(imp.values()) == pytest.approx(100)


def test_models_score_after_observe(spark, tmp_path):
    """A session that has used ``observe`` can't be sent to tasks, so no model may hold it."""
    from hazeline.operators import models

    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("x")).withColumn("fog", (F.col("x") > 15).cast("int"))
    assert report.counted(df, lambda rows: rows.write.parquet(str(tmp_path / "x")), fog=F.col("fog") == 1) == {"rows": 200, "fog": 40}
    rows = models.assembled(df, ["x"])
    for fitted in (models.logistic(df, ["x"], max_iter=5), models.sequence_net(rows, 1, hidden=(2,), epochs=5)):
        assert models.scored(fitted, rows).where("score >= 0").count() == 200
        assert models.importance(fitted, ["x"], spark).count() == 1


@pytest.mark.parametrize("limit", [asof.BUCKET_ROWS, 1])
def test_asof_windows_run_on_from_row_to_row(spark, monkeypatch, limit):
    """No frame reaches to the end of its partition, which Spark would go through again for each row."""
    monkeypatch.setattr(asof, "BUCKET_ROWS", limit)
    right = spark.range(50).select(F.lit("a").alias("location"), (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("time"), F.col("id").alias("v"))
    found = asof.nearest(right.select("location", "time"), right, ["v"], 30, order=["v"])
    assert "UnboundedFollowing" not in found._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing", "UnboundedFollowing")
    assert found.where("diff_minutes = 0").count() == 50


def test_rows_of_a_large_group_do_not_meet_in_a_join(spark, monkeypatch):
    """Brackets come to the rows as a broadcast, whatever the session's threshold; small groups have none and need none."""
    monkeypatch.setattr(quantiles, "WHOLE", 50)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(F.when(F.col("id") < 960, "large").otherwise(F.when(F.col("id") < 990, "small")).alias("g"), F.col("id").cast("double").alias("value"))
        found = quantiles.summarised(df, ["g"], [0.25, 0.5])
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r["g"]: r["_q"] for r in found.collect()} == {"large": [239.75, 479.5], "small": [967.25, 974.5], None: [992.25, 994.5]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_large_keys_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """Rows of a key over the limit are cut into cells before they are sorted for writing; none gets lost."""
    from hazeline.sources import files

    monkeypatch.setattr(files, "FILE_ROWS", 100, raising=False)
    df = spark.range(2000).select(F.when(F.col("id") < 1500, "a").otherwise("b").alias("location"), F.col("id").alias("k"))
    files.write_csv(df, str(tmp_path / "csv"))
    names = list((tmp_path / "csv" / "location=a").glob("*.csv"))
    assert len(names) > 5 and max(len(n.read_text().splitlines()) for n in names) < 600
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).select(F.col("k").cast("long")).distinct().count() == 2000
