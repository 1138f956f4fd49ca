"""Missing values: sentinels, medians, dropped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.scalar import null_above, null_if
from hazeline.operators.quantiles import medians
from hazeline.schema import VISIBILITY_LIMIT


def sentinel_to_null(df: DataFrame, sentinels: dict[str, float]) -> DataFrame:
    """Each named column's sentinel becomes null; others are left alone."""
    return df.withColumns({c: null_if(F.col(c), s) for c, s in sentinels.items()})


def replace_with_median(df: DataFrame, col: str, limit: float = VISIBILITY_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Values over the limit become the median of the others (of each group)."""
    kept = df.withColumn(col, null_above(F.col(col), limit))
    return impute_median(kept, [col], by)


def drop_invalid(df: DataFrame, col: str, limit: float = VISIBILITY_LIMIT) -> DataFrame:
    return df.where(F.col(col) <= limit)


def impute_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), fit: DataFrame | None = None) -> DataFrame:
    """Nulls become the median of the column (of each group), learned on ``fit`` or on ``df`` itself."""
    found = medians(df if fit is None else fit, cols, by)
    if not by:
        one = found.first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(one[c] if one else None)) for c in cols})
    renamed = found.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(F.col(c).alias(f"_median_{c}") for c in cols))
    joined = df.join(renamed, [df[c].eqNullSafe(renamed[f"_by_{c}"]) for c in by], "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"_median_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)
