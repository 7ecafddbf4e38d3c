"""Times written by hand in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amberlog.functions.names import trimmed

_ISO = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[Tt ]+(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?))?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.](\d{1,6}))?)?\s*([AaPp][Mm])?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def _offset(z: Column) -> Column:
    """Seconds east of UTC of an offset as text; no offset is UTC."""
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(z, r"[^0-9]", "")
    return F.when(
        digits.rlike(r"^\d{2,4}$"), sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60)
    ).otherwise(0)


def change_time(mt: Column | str) -> Column:
    """Microseconds since the epoch of a change time, null if missing or unreadable.

    Read are ISO dates and times with blank or T, fraction and offset, and month/day/year with a 12- or 24-hour clock.
    Without offset the time is UTC, whatever the session's time zone.
    """
    s = trimmed(mt)
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    clock = F.regexp_replace(part(_ISO, 2), ",", ".")
    iso = F.concat(part(_ISO, 1), F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) <= 5, F.concat(clock, F.lit(":00"))).otherwise(clock), F.lit("+00:00"))
    hour = part(_US, 4).try_cast("int")
    half = F.upper(part(_US, 8))
    h24 = F.when(half == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    or0 = lambda c, n: F.when(c == "", "0" * n).otherwise(c)
    us = F.concat(
        part(_US, 3), F.lit("-"), F.lpad(part(_US, 1), 2, "0"), F.lit("-"), F.lpad(part(_US, 2), 2, "0"), F.lit(" "), F.lpad(h24.cast("string"), 2, "0"),
        F.lit(":"), or0(part(_US, 5), 2), F.lit(":"), or0(part(_US, 6), 2), F.lit("."), or0(part(_US, 7), 1), F.lit("+00:00"),
    )
    micros = lambda text: F.unix_micros(text.try_cast("timestamp"))
    return F.when(s.rlike(_ISO), micros(iso) - _offset(part(_ISO, 3)).cast("bigint") * 1_000_000).when(s.rlike(_US), micros(us) - _offset(part(_US, 9)).cast("bigint") * 1_000_000)
