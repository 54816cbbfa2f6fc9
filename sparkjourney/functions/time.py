"""Time expressions on TIMESTAMP_NTZ columns.

Differences are taken in microseconds with ``timestamp_diff`` directly on the
naive timestamps, so no session time zone (and no DST jump) can leak into a
duration.  Seconds keep their fraction, whole days are floored.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkjourney.functions.scalar import _col

_EPOCH = "1970-01-01 00:00:00"


def seconds_between(start, end) -> Column:
    """``end - start`` in (fractional) seconds; NULL if either side is NULL."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)


def minutes_between(start, end) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def whole_days_between(start, end) -> Column:
    """Floor of the elapsed days (a timedelta's ``.days``), as BIGINT.

    ``datediff`` would count midnights crossed instead, which differs for
    timestamps that are not at midnight.
    """
    return F.floor(F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(86400e6)).cast("bigint")


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970-01-01 of a naive timestamp (BIGINT)."""
    return F.timestamp_diff("SECOND", F.lit(_EPOCH).cast("timestamp_ntz"), _col(ts))


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (not ``dayofweek``)."""
    return F.weekday(_col(ts)).cast("int")


def parse_timestamp(s, strict: bool = False) -> Column:
    """String -> TIMESTAMP_NTZ.  Unparseable input gives NULL unless ``strict``."""
    c = _col(s)
    return c.cast("timestamp_ntz") if strict else c.try_cast("timestamp_ntz")


def timestamp_from_parts(year, month, day, mmss) -> Column:
    """Build ``YYYY-MM-DD 00:<mm:ss.f>`` from date parts and a minute:second string.

    Any NULL part, an out-of-range month/day or a minute/second that does not
    exist (e.g. 66) yields NULL, never an error and never a Python UDF.
    """
    ok = _col(year).isNotNull() & _col(month).isNotNull() & _col(day).isNotNull() & _col(mmss).isNotNull()
    text = F.format_string("%d-%02d-%02d 00:%s", _col(year), _col(month), _col(day), _col(mmss))
    return F.when(ok, text.try_cast("timestamp_ntz"))
