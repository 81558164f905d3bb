"""Column functions (JVM-side expressions only; no Python UDFs)."""

from meterkit.functions.ids import canonical_uuid, md5_uuid, packed_uuid, unpacked_uuid, uuid5_col, uuid5_name, uuid5_of
from meterkit.functions.timeutil import (
    DAY_US,
    HOUR_US,
    SECOND_US,
    floor_div,
    from_us,
    iso_z,
    isoformat_utc,
    parse_ts,
    to_us,
)

__all__ = [
    "DAY_US",
    "HOUR_US",
    "SECOND_US",
    "canonical_uuid",
    "floor_div",
    "from_us",
    "iso_z",
    "isoformat_utc",
    "md5_uuid",
    "packed_uuid",
    "parse_ts",
    "to_us",
    "unpacked_uuid",
    "uuid5_col",
    "uuid5_name",
    "uuid5_of",
]
