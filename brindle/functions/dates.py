"""Times as texts and differences. Timestamps are instants; texts are in UTC unless a zone is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the days, Monday first.
WEEKDAYS = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]


def iso(at: Column) -> Column:
    """An instant of a UTC session as ISO text with microseconds and offset."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def local_text(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """Local date, weekday and time of an instant of a UTC session."""
    local = F.from_utc_timestamp(at, zone)
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd"), F.get(F.array(*map(F.lit, WEEKDAYS)), F.weekday(local)), F.date_format(local, "HH:mm"))


def expired(expires_at: Column, now: Column) -> Column:
    return expires_at <= now


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_millis(end) - F.unix_millis(start)).cast("long")


def left_ms(start: Column, now: Column, budget_ms: Column) -> Column:
    """What is left of a budget, 0 at least."""
    return F.greatest(F.lit(0), budget_ms - elapsed_ms(start, now)).cast("long")
