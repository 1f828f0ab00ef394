"""Time expressions: parsing, age in days, staleness."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ts_lit(value) -> Column:
    """A timestamp literal from a datetime / ISO string / Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=_dt.timezone.utc)
        return F.timestamp_micros(F.lit(int(value.timestamp() * 1_000_000)))
    if isinstance(value, str):
        return F.to_timestamp(F.lit(value))
    raise TypeError(f"cannot make a timestamp from {value!r}")


#: An ISO-8601 date (dashed or compact), with or without a time and an offset.
_ISO = (r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
        r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$")


def parse_ts(col, as_of) -> Column:
    """ISO-8601 text to a timestamp: a whole date, dashed or compact, with a
    time or without; ``Z`` and offsets accepted, offset-less text is UTC.
    Anything else (a time alone, a year, a month), impossible dates and
    missing text give ``as_of``, so the result never depends on today."""
    text = F.trim(_c(col))
    part = lambda i, default="": F.coalesce(F.nullif(F.regexp_extract(text, _ISO, i), F.lit("")), F.lit(default))
    month, day = F.concat(part(2), part(4)), F.concat(part(3), part(5))
    offset = F.regexp_replace(part(10, "Z"), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    offset = F.when(F.length(offset) == 4, F.concat(offset, F.lit("00"))).otherwise(offset)
    iso = F.concat(part(1), F.lit("-"), month, F.lit("-"), day, F.lit("T"), part(6, "00"), F.lit(":"), part(7, "00"), F.lit(":"),
                   part(8, "00"), F.lit("."), F.rpad(part(9, "0"), 6, "0"), offset)
    return F.coalesce(F.when(text.rlike(_ISO), F.try_to_timestamp(iso)), ts_lit(as_of))


def age_days(as_of, created="created_at") -> Column:
    """Whole days elapsed (floor of elapsed time / 24h), not calendar days."""
    delta = F.unix_micros(ts_lit(as_of)) - F.unix_micros(_c(created))
    return F.floor(delta / F.lit(MICROS_PER_DAY)).cast("bigint")


def is_stale(as_of, threshold_days: int = 180, created="created_at") -> Column:
    """``age_days > threshold``."""
    return age_days(as_of, created) > F.lit(threshold_days)


def stale_cutoff(as_of, threshold_days: int = 180) -> Column:
    """``as_of - N days`` as a timestamp."""
    return ts_lit(as_of) - F.make_dt_interval(F.lit(threshold_days))
