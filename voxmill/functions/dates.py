"""Dates and time frames."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})([.,]\d+)?)?)? ?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
# Steps from any form above to the one that a cast knows: dashes, colons, minutes and seconds, offset.
_END = r"(?=$| ?[Z+-])"
_COMPLETED = [
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"),
    (r"^(.{10}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
    (rf"^(.{{10}}[T ]\d{{2}})(\d{{2}}){_END}", "$1:$2"),
    (rf"^(.{{10}}[T ]\d{{2}}){_END}", "$1:00"),
    (rf"^(.{{10}}[T ]\d{{2}}:\d{{2}}){_END}", "$1:00"),
    (r"(:\d{2}(?:[.,]\d+)?) ?([+-]\d{2})$", "$1$2:00"),
    (r"(:\d{2}(?:[.,]\d+)?) ?([+-]\d{2})(\d{2})$", "$1$2:$3"),
    (r"(:\d{2}),(\d)", "$1.$2"),
]


def parse_date(text: Column) -> Column:
    """ISO date text to a timestamp, else null.

    A whole date, dashed or not, then optionally hours, minutes, seconds and
    fractions, then optionally ``Z`` or an offset; without one it is UTC.  A
    year or month alone, a time alone and zone names are no dates: the result
    never depends on the clock.
    """
    told = F.regexp_extract(F.upper(F.trim(text)), _ISO, 0)
    for pattern, form in _COMPLETED:
        told = F.regexp_replace(told, pattern, form)
    return told.try_cast("timestamp")


def timeframe_seconds(text: Column, default_days: int = 7) -> Column:
    """``'<n>h'`` or ``'<n>d'`` to seconds; anything else is the default."""
    lowered = F.trim(F.lower(text))
    amount = F.regexp_extract(lowered, r"^([+-]?\d+)[hd]$", 1).try_cast("bigint")
    unit = F.when(lowered.endswith("h"), F.lit(3600)).otherwise(F.lit(86400))
    return F.coalesce(amount * unit, F.lit(default_days * 86400)).cast("bigint")


def parse_timeframe(text: str, default_days: int = 7) -> timedelta:
    """The same rule for a single job argument."""
    found = re.fullmatch(r"([+-]?\d+)([hd])", text.strip().lower())
    if not found:
        return timedelta(days=default_days)
    amount = int(found.group(1))
    return timedelta(hours=amount) if found.group(2) == "h" else timedelta(days=amount)
