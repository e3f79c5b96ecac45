"""Column functions on times. All timestamps are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
# fixed value: the compact time format of the feeds
COMPACT_FORMAT = "yyMMddHHmm"
LOCAL_ZONE = "Europe/Berlin"


def parse_compact_ts(text: Column) -> Column:
    """``yyMMddHHmm`` to a timestamp; null and malformed text give null."""
    return F.try_to_timestamp(text, F.lit(COMPACT_FORMAT)).cast(NTZ)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, rounded towards minus infinity."""
    return F.floor((epoch_seconds(later) - epoch_seconds(earlier)) / 60).cast("int")


def seconds_of_gap(later: Column, earlier: Column) -> Column:
    """The gap modulo one day, never negative."""
    return F.pmod(epoch_seconds(later) - epoch_seconds(earlier), F.lit(86400))


def stay_minutes(arrival: Column, departure: Column) -> Column:
    return F.floor(seconds_of_gap(departure, arrival) / 60).cast("int")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def weekday_from_monday(ts: Column) -> Column:
    return F.weekday(ts)


def floor_to_seconds(ts: Column, step: int) -> Column:
    """Floor to a multiple of ``step`` seconds counted from 1970-01-01."""
    seconds = epoch_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(step))).cast(NTZ)


def round_to_day(ts: Column) -> Column:
    """Nearest midnight; exactly noon goes to the even day number."""
    seconds = epoch_seconds(ts)
    day = F.floor(seconds / 86400)
    rest = seconds - day * 86400
    up = (rest > 43200) | ((rest == 43200) & (F.pmod(day, F.lit(2)) == 1))
    return F.timestamp_seconds((day + F.when(up, 1).otherwise(0)) * 86400).cast(NTZ)


def utc_to_local(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """ISO-8601 text with an offset to naive local time."""
    utc = F.try_to_timestamp(text).cast(NTZ)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """``H:MM``, with ``N day(s), `` in front from one day on; negative spans count back."""
    days = F.floor(seconds / 86400)
    rest = F.pmod(seconds, F.lit(86400))
    number = lambda value: F.floor(value).cast("string")
    clock = F.concat(number(rest / 3600), F.lit(":"), F.lpad(number(F.pmod(rest, F.lit(3600)) / 60), 2, "0"))
    unit = F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))


def clock_to_hour(hhmm: Column) -> Column:
    """Clock number HHMM to an hour: half-even rounding, then up when minutes exceed 30."""
    return (F.bround(hhmm / 100, 0) + F.when(F.pmod(hhmm, F.lit(100)) > 30, 1).otherwise(0)).cast("int")


def clock_minutes(text: Column) -> Column:
    """``HH:mm`` to minutes since midnight."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)).cast("int") * 60 + F.get(parts, F.lit(1)).cast("int")
