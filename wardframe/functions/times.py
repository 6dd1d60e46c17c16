"""Lenient date and time handling for free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
_CLOCK = "^([0-9]{1,2}):?([0-9]{2})(?::[0-9]{2})? ?([ap]?)"


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def clinical_timestamp(date: Column, clock: Column | None = None) -> Column:
    """``'[**2100-1-1**]'`` and ``'1:23am'`` / ``'0530'`` -> timestamp without zone.

    NULL when the date does not parse; midnight when the clock does not. A bare ``a`` or
    ``p`` counts as am or pm.
    """
    parts = [F.regexp_extract(date, _DATE, i) for i in (1, 2, 3)]
    day = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    if clock is None:
        return day.try_cast("timestamp_ntz")
    raw_hour = F.regexp_extract(clock, _CLOCK, 1)
    minute = F.regexp_extract(clock, _CLOCK, 2)
    half = F.regexp_extract(clock, _CLOCK, 3)
    hour = raw_hour.try_cast("int")
    hour = (
        F.when((half == "p") & (hour < 12), hour + 12)
        .when((half == "a") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    stamp = F.concat_ws(
        " ", day, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":00"))
    )
    return F.coalesce(stamp.try_cast("timestamp_ntz"), day.try_cast("timestamp_ntz"))


def clock_on_day(day: Column, clock: Column) -> Column:
    """Put a ``HHMM`` or ``HH:MM`` clock on the day of a timestamp; the timestamp itself
    when the clock is missing or impossible."""
    return F.coalesce(
        F.when(F.length(clock) > 0, F.concat_ws(" ", date_text(day), clock_text(clock))).try_cast(
            "timestamp_ntz"
        ),
        day,
    )


def clock_text(clock: Column) -> Column:
    digits = F.lpad(F.replace(clock, F.lit(":"), F.lit("")), 4, "0")
    return F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2), F.lit(":00"))


def yearless_date(date: Column, reference: Column) -> Column:
    """``'2-14'`` takes the year of ``reference``; a full date keeps its own."""
    head = F.split_part(date, F.lit("-"), F.lit(1))
    second = F.split_part(date, F.lit("-"), F.lit(2))
    third = F.split_part(date, F.lit("-"), F.lit(3))
    short = F.concat_ws(
        "-", F.year(reference).cast("string"), F.lpad(head, 2, "0"), F.lpad(second, 2, "0")
    )
    full = F.concat_ws("-", head, F.lpad(second, 2, "0"), F.lpad(third, 2, "0"))
    return F.when(F.length(head) < 4, short).otherwise(full)


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' HOUR")
