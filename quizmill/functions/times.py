"""Times: stored in UTC, shown on a UTC+8 wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+08:00"


def local_minute(ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm`` in UTC+8; null and zero give ''."""
    shown = F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), ZONE), "yyyy-MM-dd HH:mm")
    return F.when(ms.isNull() | (ms == 0), F.lit("")).otherwise(shown)


def parse_local(s: Column) -> Column:
    """The instant of such a string; null if it is no date."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.nullif(F.trim(s), F.lit("")), F.lit("yyyy-MM-dd HH:mm")), ZONE)


def period_label(ts: Column) -> Column:
    """``YYYYQn``; null for null."""
    return F.concat(F.date_format(ts, "yyyy"), F.lit("Q"), F.quarter(ts).cast("string"))
