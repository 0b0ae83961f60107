"""Local clocks: a zone is an IANA name or a fixed offset in hours. Results don't depend on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
Zone = str | int | float


def local_ms(zone: Zone = 0, ms: str = "ms") -> Column:
    """Milliseconds of the wall clock: those of UTC, moved by the zone's offset at that time."""
    c = F.col(ms)
    if isinstance(zone, str):
        return c if zone == "UTC" else F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(c), zone))
    return c + int(zone * HOUR_MS) if zone else c


def local_day(zone: Zone = 0, ms: str = "ms") -> Column:
    """Days since 1970 on the wall clock."""
    return F.floor(local_ms(zone, ms) / DAY_MS)


def local_date(zone: Zone = 0, ms: str = "ms") -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), local_day(zone, ms).cast("int"))


def local_hour(zone: Zone = 0, ms: str = "ms") -> Column:
    return F.floor(F.pmod(local_ms(zone, ms), F.lit(DAY_MS)) / HOUR_MS).cast("int")


def local_weekday(zone: Zone = 0, ms: str = "ms") -> Column:
    """0 is Sunday."""
    return F.pmod(local_day(zone, ms) + 4, F.lit(7)).cast("int")


def local_month(zone: Zone = 0, ms: str = "ms") -> Column:
    return F.date_format(local_date(zone, ms), "yyyy-MM")


def half_up(c: Column, places: int = 0) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(c * 10**places + 0.5) / 10**places
