"""Slots and time formats.

Times are ``TIMESTAMP_NTZ`` read as UTC, so no result depends on the session time zone. A watermark needs an
instant: ``to_instant`` / ``from_instant`` convert without going through the session zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.constants import BACKFILL_SLOTS, DAY_FORMAT, HOUR_FORMAT, SECOND_FORMAT, SLOT_HOURS


def ntz(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def _epoch() -> Column:
    return ntz("1970-01-01 00:00:00")


def epoch_seconds(ts: Column) -> Column:
    return F.timestamp_diff("SECOND", _epoch(), ts)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("bigint"), _epoch())


def to_instant(ts: Column) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), ts))


def from_instant(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), _epoch())


def slot_start(ts: Column, hours: int = SLOT_HOURS) -> Column:
    """Start of the slot that holds ``ts``."""
    width = hours * 3600
    return from_epoch_seconds(F.floor(epoch_seconds(ts) / F.lit(width)) * F.lit(width))


def in_slot(ts: Column, slot_end: Column, hours: int = SLOT_HOURS) -> Column:
    """``slot_end - hours <= ts < slot_end``: half-open, so neighbouring slots never share a row."""
    return (ts >= shift_hours(slot_end, -hours)) & (ts < slot_end)


def shift_hours(ts: Column, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours), ts)


def shift_days(ts: Column, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(days), ts)


def hour_start(ts: Column) -> Column:
    return slot_start(ts, 1)


def slot_array(start: Column, n: int = BACKFILL_SLOTS, hours: int = SLOT_HOURS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.timestamp_add("HOUR", i * F.lit(hours), start))


def slot_series(spark: SparkSession, start: datetime | str, n: int = BACKFILL_SLOTS,
                hours: int = SLOT_HOURS) -> DataFrame:
    """One row per slot, ``n`` slots from ``start``."""
    return spark.range(n).select(
        F.timestamp_add("HOUR", (F.col("id") * hours).cast("int"), ntz(start)).alias("slot"))


def second_key(ts: Column) -> Column:
    return F.date_format(ts, SECOND_FORMAT)


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, HOUR_FORMAT)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, DAY_FORMAT)
