"""Explicit schemas of the stored tables and the input messages (no schema inference)."""

from pyspark.sql.types import (
    ArrayType,
    DecimalType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

PRICE = DecimalType(38, 12)
TS = TimestampNTZType()


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


WORKSPACE_ACCOUNT = _s(("workspace", StringType(), False), ("account", StringType(), False))
BILLING_ITEM = _s(("uuid", StringType(), False), ("sku", StringType(), False), ("name", StringType(), False), ("unit", StringType(), False))
BILLING_ITEM_PRICE = _s(
    ("uuid", StringType(), False),
    ("item_id", StringType(), False),
    ("price", PRICE, False),
    ("valid_from", TS, False),
    ("valid_until", TS, True),
    ("configured_at", TS, False),
)
# the price list as it stood at any past moment: each state of a row with the time it was loaded and closed
PRICE_HISTORY = StructType([*BILLING_ITEM_PRICE.fields, StructField("known_from", TS, False), StructField("known_until", TS, True)])
BILLING_EVENT = _s(
    ("uuid", StringType(), False),
    ("event_start", TS, False),
    ("event_end", TS, False),
    ("item_id", StringType(), False),
    ("user", StringType(), True),
    ("workspace", StringType(), False),
    ("quantity", DoubleType(), False),
)
RATE_SAMPLE = _s(
    ("uuid", StringType(), False),
    ("sample_time", TS, False),
    ("item_id", StringType(), False),
    ("user", StringType(), True),
    ("workspace", StringType(), False),
    ("rate", DoubleType(), False),
)
# per-key estimation state: one row with ``resume_at`` per key that has one, plus the key's
# pending samples (from the last one at or before the resume point onward)
ESTIMATE_STATE = _s(
    ("workspace", StringType(), False),
    ("item_id", StringType(), False),
    ("resume_at", TS, True),
    ("uuid", StringType(), True),
    ("sample_time", TS, True),
    ("rate", DoubleType(), True),
)
# rejected messages: the message as it came (JSON) and the digest of that text, which with the position names it
QUARANTINE = _s(("uuid", StringType(), True), ("ingest_seq", LongType(), True), ("reason", StringType(), False), ("payload", StringType(), True), ("digest", StringType(), True))
WORKSPACE_QUARANTINE = _s(
    ("name", StringType(), True),
    ("account", StringType(), True),
    ("ingest_seq", LongType(), True),
    ("reason", StringType(), False),
    ("payload", StringType(), True),
    ("digest", StringType(), True),
)

# messages as they arrive (text fields); ingest_seq is the source position
EVENT_MESSAGE = _s(
    ("uuid", StringType(), True),
    ("event_start", StringType(), True),
    ("event_end", StringType(), True),
    ("sku", StringType(), True),
    ("user", StringType(), True),
    ("workspace", StringType(), True),
    ("quantity", DoubleType(), True),
    ("ingest_seq", LongType(), True),
)
SAMPLE_MESSAGE = _s(
    ("uuid", StringType(), True),
    ("sample_time", StringType(), True),
    ("sku", StringType(), True),
    ("user", StringType(), True),
    ("workspace", StringType(), True),
    ("rate", DoubleType(), True),
    ("ingest_seq", LongType(), True),
)
WORKSPACE_MESSAGE = _s(("name", StringType(), True), ("account", StringType(), True), ("ingest_seq", LongType(), True))

# configuration document: items[] and prices[]
CONFIG = _s(
    ("items", ArrayType(_s(("sku", StringType(), True), ("name", StringType(), True), ("unit", StringType(), True))), True),
    ("prices", ArrayType(_s(("sku", StringType(), True), ("valid_from", StringType(), True), ("price", StringType(), True))), True),
)

TABLES = {
    "workspace_account": WORKSPACE_ACCOUNT,
    "billing_item": BILLING_ITEM,
    "billing_item_price": BILLING_ITEM_PRICE,
    "price_history": PRICE_HISTORY,
    "billing_event": BILLING_EVENT,
    "rate_sample": RATE_SAMPLE,
    "event_quarantine": QUARANTINE,
    "sample_quarantine": QUARANTINE,
    "workspace_quarantine": WORKSPACE_QUARANTINE,
    "estimate_state": ESTIMATE_STATE,
}
