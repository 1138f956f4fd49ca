"""Features of hourly series: lags, night minima, z-scores, scaling, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.functions.scalar import round_half_even
from hazeline.operators.positions import reaching_back


def dewpoint_depression(df: DataFrame, temp: str = "temperature_2m", dew: str = "dew_point_2m", name: str = "dewpoint_depression") -> DataFrame:
    return df.withColumn(name, F.col(temp) - F.col(dew))


def cooling_rates(df: DataFrame, hours: Sequence[int] = (6, 12), temp: str = "temperature_2m", by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """cooling_rate_<h>h: (value - value h rows before) / h, by position; null for a series' first h rows."""

    def make(d: DataFrame, spec) -> DataFrame:
        return d.withColumns({f"cooling_rate_{h}h": (F.col(temp) - F.lag(temp, h).over(spec)) / F.lit(float(h)) for h in hours})

    return reaching_back(df, by, [time], max(hours), make).drop("rn")


def previous_night_low(df: DataFrame, temp: str = "temperature_2m", by: Sequence[str] = ("location",), time: str = "time", name: str = "previous_night_low") -> DataFrame:
    """Least value from 18-23 h of the previous existing day and 0-5 h of the day, for all rows of the day.

    A series' first day has none. The rows of 0-5 h see their own minimum, as
    in the definition reproduced here.
    """
    hour, day = F.hour(time), F.to_date(time)
    days = df.groupBy(*by, day.alias("_day")).agg(
        F.min(F.when(hour >= 18, F.col(temp))).alias("_evening"), F.min(F.when(hour < 6, F.col(temp))).alias("_morning")
    )
    w = W.partitionBy(*by).orderBy("_day")  # one row a day: bounded by the calendar
    low = F.when(F.row_number().over(w) > 1, F.least(F.lag("_evening").over(w), F.col("_morning")))
    lows = days.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_day", low.alias(name))
    match = [df[c].eqNullSafe(lows[f"_by_{c}"]) for c in by] + [day == lows["_day"]]
    return df.join(lows, match, "left").select(*df.columns, name)


def append_inferred(df: DataFrame) -> DataFrame:
    """The four inferred columns, rounded half to even at two digits."""
    out = previous_night_low(cooling_rates(dewpoint_depression(df)))
    names = ("dewpoint_depression", "cooling_rate_6h", "cooling_rate_12h", "previous_night_low")
    return out.withColumns({c: round_half_even(F.col(c)) for c in names})


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("location",)) -> DataFrame:
    """(x - mean) / sample deviation of each group; columns without spread stay as they are."""
    stats = df.groupBy(*by).agg(*(F.avg(c).alias(f"_mean_{c}") for c in cols), *(F.stddev_samp(c).alias(f"_dev_{c}") for c in cols))
    stats = stats.select(*(F.col(c).alias(f"_by_{c}") for c in by), *[c for c in stats.columns if c not in by])
    joined = df.join(stats, [df[c].eqNullSafe(stats[f"_by_{c}"]) for c in by])
    scaled = {c: F.when(F.col(f"_dev_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_dev_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.select(*(scaled[c].alias(c) if c in scaled else df[c] for c in df.columns))


def standardize(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation, learned on ``fit`` (one eager aggregate); a column without spread is only centred."""
    source = df if fit is None else fit
    found = source.agg(*(F.avg(c).alias(f"mean_{c}") for c in cols), *(F.stddev_pop(c).alias(f"dev_{c}") for c in cols)).first()
    return df.withColumns({c: (F.col(c) - F.lit(found[f"mean_{c}"])) / F.lit(found[f"dev_{c}"] or 1.0) for c in cols})


def sequences(df: DataFrame, cols: Sequence[str], length: int = 24, by: Sequence[str] = ("location",), time: str = "time", max_gap_hours: float | None = None) -> DataFrame:
    """Rows with ``sequence``: the ``length`` rows before each, by position; rows with fewer before them go.

    With ``max_gap_hours``, rows whose window spans a larger gap between
    neighbours go as well.
    """

    def make(d: DataFrame, spec) -> DataFrame:
        frame = spec.rowsBetween(-length, -1)
        # a struct keeps rows of nulls, which a list of values would drop
        d = d.withColumn("sequence", F.collect_list(F.struct(*cols)).over(frame))
        if max_gap_hours is not None:
            gap = F.timestamp_diff("SECOND", F.lag(time).over(spec), F.col(time))
            d = d.withColumn("_gap", gap).withColumn("_gap", F.max("_gap").over(spec.rowsBetween(-length + 1, 0)))
        return d

    out = reaching_back(df, by, [time], 2 * length, make).where(F.size("sequence") == length)
    if max_gap_hours is not None:
        out = out.where(F.col("_gap") <= max_gap_hours * 3600).drop("_gap")
    return out


def after_first(df: DataFrame, rows: int = 24, by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """Rows from the position after ``rows`` on: those that have a full sequence."""
    from hazeline.operators.positions import numbered

    return numbered(df, by, [time]).where(F.col("rn") > rows).drop("rn")


def last_fraction(df: DataFrame, fraction: float = 0.2, by: Sequence[str] = ("location",), time: str = "time") -> DataFrame:
    """``is_validation``: the last rows of each series, from position floor(n * (1 - fraction)) on."""
    from hazeline.operators.positions import numbered

    n = numbered(df, by, [time])
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    return n.join(sizes, list(by)).withColumn("is_validation", F.col("rn") > F.floor(F.col("_n") * F.lit(1 - fraction))).drop("rn", "_n")
