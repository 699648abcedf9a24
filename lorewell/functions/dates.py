"""Calendar and back-off arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601-01-01, the browsers' epoch, to 1970-01-01.
BROWSER_EPOCH = 11_644_473_600_000_000


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """UTC instants at which a local calendar day begins and the next one does; 23 to 25 hours apart."""
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), zone)
    return start(day), start(F.date_add(day, 1))


def local_day(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(at, zone).cast("date")


def from_browser(micros: Column) -> Column:
    return F.timestamp_micros(micros - BROWSER_EPOCH)


def to_browser(at: Column) -> Column:
    return F.unix_micros(at) + BROWSER_EPOCH


def iso_week(at: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def back_off(attempt: Column, base: float, most: float) -> Column:
    """Seconds before the next attempt: doubling from the base up to the most."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def retire_cap(active: Column) -> Column:
    """How many active rows one pass may retire."""
    return F.greatest(F.lit(25), F.floor(active / 10))
