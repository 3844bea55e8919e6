"""Time expressions: lenient UTC parsing, ISO text, Paris business dates, windows.

All of them expect the session time zone to be UTC (see ``session.prepare``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "Europe/Paris"

# Formats tried after ISO 8601, most specific first.
EXTRA_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "MM/dd/yyyy",
)


def parse_ts_utc(value: Column) -> Column:
    """Text to instant; empty or unreadable text gives NULL instead of an error."""
    text = F.btrim(value)
    # A zone name or a bare time of day would be read against today's date.
    iso = F.when(text.rlike(r"^\d{4}(-|$)"), F.try_to_timestamp(text))
    plain = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")  # mail dates name the weekday
    return F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in EXTRA_FORMATS])


def iso_utc(ts: Column) -> Column:
    """ISO text with offset; microseconds only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros != ".000000", micros).otherwise(""), F.lit("+00:00"))


def paris_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, BUSINESS_ZONE))


def in_window(ts: Column, as_of: Column, days: int) -> Column:
    """Paris date of ``ts`` is not older than ``days`` days before that of ``as_of``."""
    return paris_date(ts) >= F.date_sub(paris_date(as_of), days)


def date_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def week_start(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", ts))
