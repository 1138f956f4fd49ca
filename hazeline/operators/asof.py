"""Nearest-time joins with a tolerance.

Both sides are cut into time buckets; right rows within the tolerance of a
bucket's edge are also shown to the neighbour, so every match lies in one
bucket. There the nearest right rows before and after come from two windows
over the union of both sides. No pair is built, and a long series spreads over
its buckets.

Where a bucket holds too many rows for one task, both sides are cut into blocks
by position instead: right rows of one time become one, a range shuffle deals
the ordered rows out evenly whatever their times, and each block learns the
nearest right rows outside it from a scan over one summary a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeline.functions.scalar import micros
from hazeline.sources.shared import spool

BACKWARD, FIRST = "backward", "first"
#: Rows of a time bucket that one task may sort.
BUCKET_ROWS = 5_000_000
_ZERO = "timestamp_ntz '1970-01-01 00:00:00'"


def nearest(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    tolerance_minutes: float,
    by: Sequence[str] = ("location",),
    on: str = "time",
    right_on: str | None = None,
    tie: str = BACKWARD,
    order: Sequence[str] = (),
    bucket_hours: int = 24,
) -> DataFrame:
    """Every row of ``left`` with ``payload`` and ``diff_minutes`` of its nearest row of ``right``, or nulls.

    The tolerance is inclusive. tie="backward": at equal distance the earlier
    row, and of equal times the last by ``order``; tie="first": the first by
    ``order`` of all at the least distance. Rows without a time match nothing;
    null keys match each other. Rows are counted by bucket at once, to choose
    between buckets and blocks, which give the same rows.
    """
    right_on = right_on or on
    tolerance = int(tolerance_minutes * 60_000_000)
    width = max(bucket_hours * 3_600_000_000, 2 * tolerance)
    zero = F.expr(_ZERO)
    seq = F.struct(*order) if order else F.lit(0)
    t = micros(F.col(right_on), zero)
    r = right.select(*by, t.alias("_t"), seq.alias("_seq"), F.struct(t.alias("_rt"), seq.alias("_rs"), *payload).alias("_right")).where(F.col("_t").isNotNull())
    near = F.array_distinct(F.array(*(F.floor((F.col("_t") + d) / width) for d in (-tolerance, 0, tolerance))))
    r = r.withColumn("_bucket", F.explode(near)).withColumn("_left", F.lit(None).cast(left.schema))
    lt = micros(F.col(on), zero)
    if _largest(r.select(*by, "_bucket"), left.select(*by, F.floor(lt / width).alias("_bucket")), by) > BUCKET_ROWS:
        return _in_blocks(left, lt, right, t, seq, payload, tolerance, by, tie)
    none = F.lit(None)
    l = left.select(  # noqa: E741
        *by, lt.alias("_t"), none.cast(r.schema["_seq"].dataType).alias("_seq"), none.cast(r.schema["_right"].dataType).alias("_right"),
        F.floor(lt / width).alias("_bucket"), F.struct(*left.columns).alias("_left"),
    )
    both = l.unionByName(r).withColumn("_side", F.col("_right").isNull().cast("int"))  # right rows first
    parts = W.partitionBy(*by, "_bucket")
    seq_back = F.col("_seq").asc() if tie == BACKWARD else F.col("_seq").desc()
    back = F.last("_right", ignorenulls=True).over(parts.orderBy("_t", "_side", seq_back).rowsBetween(W.unboundedPreceding, 0))
    # the next right row is the last one in the reverse order: a frame up to the partition's end would be summed anew for each row
    ahead = F.last("_right", ignorenulls=True).over(parts.orderBy(F.desc("_t"), "_side", F.desc("_seq")).rowsBetween(W.unboundedPreceding, 0))
    return _matched(both.withColumn("_b", back).withColumn("_f", ahead).where("_side = 1"), left.columns, payload, tolerance, tie)


def _matched(found: DataFrame, columns: Sequence[str], payload: Sequence[str], tolerance: int, tie: str) -> DataFrame:
    """Of the right rows before (_b) and after (_f) each left row the one that matches, if any."""
    db, df = F.col("_t") - F.col("_b._rt"), F.col("_f._rt") - F.col("_t")
    first = (db <= df) if tie == BACKWARD else (db < df) | (db == df) & (F.col("_b._rs") <= F.col("_f._rs"))
    found = found.withColumn("_m", F.when(F.col("_b").isNotNull() & (F.col("_f").isNull() | first), F.col("_b")).otherwise(F.col("_f")))
    away = F.abs(F.col("_t") - F.col("_m._rt"))
    ok = away <= tolerance
    return found.select(
        *(F.col(f"_left.{c}").alias(c) for c in columns),
        *(F.when(ok, F.col(f"_m.{c}")).alias(c) for c in payload),
        F.when(ok, away / F.lit(6e7)).alias("diff_minutes"),
    )


def _largest(right: DataFrame, left: DataFrame, by: Sequence[str]) -> int:
    """Rows of the fullest bucket."""
    sizes = right.unionByName(left).groupBy(*by, "_bucket").agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _in_blocks(left: DataFrame, lt: Column, right: DataFrame, t: Column, seq: Column, payload: Sequence[str], tolerance: int, by: Sequence[str], tie: str) -> DataFrame:
    """The same rows as by buckets, whatever share of them one time holds."""
    # of equal times only the first and last right rows by order can match, so many become one
    each = right.select(*by, t.alias("_t"), F.struct(seq.alias("_rs"), *payload).alias("_row")).where(F.col("_t").isNotNull())
    ends = each.groupBy(*by, "_t").agg(F.min_by("_row", "_row._rs").alias("_first"), F.max_by("_row", "_row._rs").alias("_last"))
    row = lambda c: F.struct(F.col("_t").alias("_rt"), *(F.col(f"{c}.{x}").alias(x) for x in ("_rs", *payload)))
    r = ends.select(*by, "_t", F.struct(row("_first").alias("first"), row("_last").alias("last")).alias("_right"), F.lit(None).cast(left.schema).alias("_left"), F.lit(-1).cast("long").alias("_tie"))
    l = left.select(*by, lt.alias("_t"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"), F.monotonically_increasing_id().alias("_tie"))  # noqa: E741
    spark = left.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ties among left rows only spread them: any order of theirs is right; written, so that blocks stay what they are
    dealt = spool(l.unionByName(r).repartitionByRange(count, *by, "_t", "_tie").withColumn("_block", F.spark_partition_id()), "asof-blocks")

    rights = dealt.where(F.col("_right").isNotNull())
    blocks = dealt.select(*by, "_block").distinct().withColumn("_none", F.lit(True))
    edges = rights.groupBy(*by, "_block").agg(F.min_by("_right", "_t").alias("_head"), F.max_by("_right", "_t").alias("_end"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in (*by, "_block")]
    every = blocks.join(edges, same(blocks, edges), "left").select(*(blocks[c] for c in (*by, "_block")), "_head", "_end")
    order, reverse = W.partitionBy(*by).orderBy("_block"), W.partitionBy(*by).orderBy(F.desc("_block"))
    carried = every.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_block").alias("_k"),
        F.last("_end", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.last("_head", ignorenulls=True).over(reverse.rowsBetween(W.unboundedPreceding, -1)).alias("_after"),
    )
    on = [F.col("_block") == F.col("_k"), *(F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by))]
    inner = W.partitionBy(*by, "_block")
    near = dealt
    for name, o in (("_b", inner.orderBy("_t", "_tie")), ("_f", inner.orderBy(F.desc("_t"), F.desc("_tie")))):
        near = near.withColumn(name, F.last("_right", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, 0)))
    near = near.where(F.col("_left").isNotNull())
    joined = near.join(carried, on, "left")
    back = F.coalesce("_b", "_before")["last" if tie == BACKWARD else "first"]
    return _matched(joined.select("_t", "_left", back.alias("_b"), F.coalesce("_f", "_after")["first"].alias("_f")), left.columns, payload, tolerance, tie)


def match_kinds(joined: DataFrame, diff: str = "diff_minutes") -> DataFrame:
    """kind (exact, approximate, none), n and mean_diff_minutes of joined rows."""
    kind = F.when(F.col(diff).isNull(), "none").when(F.col(diff) == 0, "exact").otherwise("approximate")
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff_minutes"))
