"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_visibility(vis: Column) -> Column:
    """First part of a composite report such as "016093,5,N,5" as an integer; null if it is none."""
    return F.element_at(F.split(vis, ","), 1).try_cast("int")


def event_label(value: Column, threshold: float, inclusive: bool = False, missing: int | None = 0) -> Column:
    """1 if ``value`` is under (or at) the threshold, else 0; ``missing`` for nulls."""
    hit = (value <= threshold) if inclusive else (value < threshold)
    return F.when(value.isNull(), F.lit(missing).cast("int")).otherwise(hit.cast("int"))


def fog_binary(value: Column) -> Column:
    """The older rule: at most 1000 m, -9999 for nulls."""
    return event_label(value, 1000, inclusive=True, missing=-9999)


def fog_label(value: Column) -> Column:
    """The models' rule: under 1610 m, nulls are no fog."""
    return event_label(value, 1610)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the scaled value half to even, as array libraries do."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def null_if(value: Column, sentinel) -> Column:
    return F.when(value != F.lit(sentinel), value)


def null_above(value: Column, limit) -> Column:
    return F.when(value <= F.lit(limit), value)


def micros(a: Column, b: Column) -> Column:
    """Microseconds from ``b`` to ``a``, both zone-less times."""
    return F.timestamp_diff("MICROSECOND", b, a)


def trunc_ntz(unit: str, time: Column) -> Column:
    """date_trunc that keeps zone-less times zone-less."""
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def in_year(time: Column, year: int) -> Column:
    """A year as a range of times, which reaches the scan; ``year(time) = y`` would not."""
    return (time >= _start(year)) & (time < _start(year + 1))


def not_in_year(time: Column, year: int) -> Column:
    return (time < _start(year)) | (time >= _start(year + 1))


def _start(year: int) -> Column:
    return F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, ``other`` where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... under ``stop``, each as start + i * step."""
    out, i = [], 0
    while start + i * step < stop:
        out.append(start + i * step)
        i += 1
    return out
