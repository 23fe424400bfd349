"""Clock arithmetic on zone-free timestamps, and integer ticks for time keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN_HOUR = 23  # Fixed value: the subject clock starts at 23:00 of the first day
TICKS_PER_HOUR = 1_000_000


def day_origin(first: Column) -> Column:
    """23:00 on the calendar day of ``first``."""
    return (F.to_date(first).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(ORIGIN_HOUR)))


def hours_between(later: Column, earlier: Column) -> Column:
    """Exact microsecond difference, as hours; independent of the session zone."""
    seconds = (later - earlier).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("long") / F.lit(3.6e9)


def minus_months(moment: Column, months: int) -> Column:
    """Calendar months earlier; null where that date does not exist."""
    shifted = moment - F.make_ym_interval(F.lit(0), F.lit(months))
    return F.when(F.dayofmonth(shifted) == F.dayofmonth(moment), shifted)


def tick(time: Column, per_hour: int = TICKS_PER_HOUR) -> Column:
    """Integer join key for a floating-point time."""
    return F.round(time * per_hour).cast("long")
