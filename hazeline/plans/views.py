"""Analogue views of the domain on the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.scalar import parse_visibility, round_half_even, trunc_ntz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows of each location (event type), with gaps."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("location"), trunc_ntz("hour", F.col("ts")).alias("time")).agg(
        round_half_even(F.avg("value"), 4).alias("temp"), F.min("value").alias("dew"), F.count("*").alias("n")
    )


def obs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap-free series over all locations."""
    e = table(spark, sf_dir, "events")
    out = e.groupBy(trunc_ntz("hour", F.col("ts")).alias("time")).agg(round_half_even(F.avg("value"), 4).alias("temp"))
    return out.select(F.lit("all").alias("location"), "time", "temp")


def metar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular visibility reports of one kind of event; some are missing."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    metres = F.when(F.col("user_id") % 10 == 0, F.lit(999999)).otherwise(F.floor(F.col("value") * 100).cast("int"))
    vis = F.concat(F.lpad(metres.cast("string"), 6, "0"), F.lit(",5,N,5"))
    return e.select(F.lit("click").alias("location"), F.col("event_id").alias("seq"), F.col("ts").alias("time"), vis.alias("VIS"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metar(spark, sf_dir)
    return m.select("location", "seq", "time", parse_visibility(F.col("VIS")).cast("double").alias("vis"))


def aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly air values that start late."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase' and ts >= timestamp_ntz '2024-01-10 00:00:00'")
    return e.groupBy(trunc_ntz("hour", F.col("ts")).alias("time")).agg(round_half_even(F.avg("value"), 4).alias("pm10"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of several years by region, with a deterministic score and some nulls."""
    li, su, na, re = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    places = su.join(na, su["s_nationkey"] == na["n_nationkey"]).join(re, na["n_regionkey"] == re["r_regionkey"]).select("s_suppkey", F.col("r_name").alias("location"))
    rows = li.join(places, li["l_suppkey"] == places["s_suppkey"])
    return rows.select(
        "location", F.col("l_shipdate").alias("time"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("code"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("gappy"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(999999.0)).otherwise(F.col("l_quantity") * 100).alias("visibility"),
        (F.col("l_discount") >= 0.1).cast("int").alias("fog"),
        round_half_even(F.lit(0.6) * F.col("l_discount") / 0.1 + F.lit(0.4) * F.col("l_tax") / 0.08, 6).alias("score"),
    )


#: The same views for DuckDB.
SQL = {
    "obs": """SELECT event_type AS location, date_trunc('hour', ts) AS time, round_even(avg(value) * 10000.0, 0) / 10000.0 AS temp, min(value) AS dew,
        count(*) AS n FROM events GROUP BY 1, 2""",
    "obs_all": "SELECT 'all' AS location, date_trunc('hour', ts) AS time, round_even(avg(value) * 10000.0, 0) / 10000.0 AS temp FROM events GROUP BY 2",
    "metar": """SELECT 'click' AS location, event_id AS seq, ts AS time, lpad(CAST(CASE WHEN user_id % 10 = 0 THEN 999999 ELSE CAST(floor(value * 100) AS INT) END
        AS VARCHAR), 6, '0') || ',5,N,5' AS VIS FROM events WHERE event_type = 'view'""",
    "seen": "SELECT location, seq, time, CAST(TRY_CAST(split_part(VIS, ',', 1) AS INT) AS DOUBLE) AS vis FROM metar",
    "aqi": """SELECT date_trunc('hour', ts) AS time, round_even(avg(value) * 10000.0, 0) / 10000.0 AS pm10 FROM events
        WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1""",
    "hist": """SELECT r_name AS location, l_shipdate AS time, l_orderkey AS k, l_linenumber AS code, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax,
        CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS gappy, CASE WHEN l_orderkey % 11 = 0 THEN 999999.0 ELSE l_quantity * 100 END AS visibility,
        CAST(l_discount >= 0.1 AS INT) AS fog,
        round_even((CAST(0.6 AS DOUBLE) * l_discount / CAST(0.1 AS DOUBLE) + CAST(0.4 AS DOUBLE) * l_tax / CAST(0.08 AS DOUBLE)) * 1000000.0, 0) / 1000000.0 AS score
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
_NEEDS = {"seen": ["metar", "seen"]}


def with_views(names: str, body: str) -> str:
    """A query with the named views as common table expressions."""
    every = dict.fromkeys(x for n in names.split() for x in _NEEDS.get(n, [n]))
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in every) + "\n" + body
