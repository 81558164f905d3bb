"""Time expressions.

Stored times are ``TIMESTAMP_NTZ`` values holding UTC wall-clock time. Arithmetic runs on
epoch microseconds (``LongType``) so hour/day buckets do not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 24 * HOUR_US


_BASIC = r"^(\d{4})(\d{2})(\d{2})($|[T ].*$)"
_BASIC_CLOCK = r"^(\d{4}-\d{2}-\d{2}[T ])(\d{2})(\d{2})(\d{2})"
_SHORT_OFFSET = r"([+-]\d{2})(\d{2})$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.]\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"
_FULL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}(:\d{2})?)?)?$"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_us(ts: Column) -> Column:
    """Epoch microseconds of a UTC wall-clock timestamp."""
    return F.timestamp_diff("MICROSECOND", _epoch(), ts.cast("timestamp_ntz"))


def from_us(us: Column) -> Column:
    """UTC wall-clock ``TIMESTAMP_NTZ`` from epoch microseconds."""
    return F.timestamp_add("MICROSECOND", us, _epoch())


def floor_div(us: Column, unit: int) -> Column:
    """Exact floor division of a long by a positive constant (bucket number)."""
    return ((us - F.pmod(us, F.lit(unit))) / F.lit(unit)).cast("long")


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to UTC wall clock: a naive value is UTC, an offset is converted.

    A whole date is required, extended (``2025-01-31``) or basic (``20250131``), with or without
    a time of day; anything else (a clock time, a year, a month) gives NULL and callers
    quarantine it. Requires a UTC session, which every query function sets. Text that is plain
    extended ISO already is parsed as it stands; only other text is rewritten first.
    """
    whole = F.regexp_replace(F.trim(text), _BASIC, "$1-$2-$3$4")
    whole = F.regexp_replace(whole, _BASIC_CLOCK, "$1$2:$3:$4")
    whole = F.regexp_replace(whole, _SHORT_OFFSET, "$1:$2")
    known = F.when(text.rlike(_PLAIN), text).otherwise(F.when(whole.rlike(_FULL), whole))
    return F.try_to_timestamp(known).cast("timestamp_ntz")


def iso_z(ts: Column) -> Column:
    """Second-resolution text stamped ``Z`` (sub-seconds truncated), as the usage API prints."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def isoformat_utc(ts: Column) -> Column:
    """Text equal to Python's ``datetime.isoformat()`` of an aware UTC value."""
    micros = F.pmod(to_us(ts), F.lit(SECOND_US))
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00"))
