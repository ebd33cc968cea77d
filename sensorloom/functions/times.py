"""Time expressions. Times are local and without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")


def parsed(text: Column, *formats: str) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in (formats or FORMATS)]).cast("timestamp_ntz")


def hour_floor(t: Column) -> Column:
    return F.date_trunc("HOUR", t).cast("timestamp_ntz")


def minutes_floor(t: Column, minutes: int) -> Column:
    """Start of the whole block of so many minutes, counted from the epoch."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    block = minutes * 60 * 1_000_000
    return F.timestamp_add("MICROSECOND", F.floor(micros / block) * block, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def block_number(t: Column, minutes: int) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t) / (minutes * 60 * 1_000_000))


def within(a: Column, b: Column, minutes: int) -> Column:
    """At most so many minutes apart; false if either is null."""
    return F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", a, b)) <= minutes * 60 * 1_000_000, F.lit(False))


def compact(t: Column) -> Column:
    return F.date_format(t, "yyyyMMddHHmmss")


def run_id(t: Column) -> Column:
    return F.date_format(t, "yyyyMMdd_HHmm")


def local_now(zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.current_timestamp().cast("timestamp_ntz"))


def to_zone(t: Column, zone: str, source: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(source), F.lit(zone), t)
