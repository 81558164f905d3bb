"""Ingest: parse and validate messages, quarantine bad rows, resolve SKUs, create stub items,
first-arrival-wins de-duplication and the first-wins workspace → account map.

Messages carry text fields (as on the wire) and a monotone ``ingest_seq`` (source offset;
for files: file order and position). Where a source has a position that no single number holds,
it comes as ``ingest_at``, a struct that sorts by arrival. A bad record is rejected permanently
with a reason; transient failures are Spark task retries, not data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.functions import canonical_uuid, md5_uuid, parse_ts
from meterkit.operators.dims import measured_dim

EVENT_FIELDS = ["uuid", "event_start", "event_end", "sku", "user", "workspace", "quantity"]
SAMPLE_FIELDS = ["uuid", "sample_time", "sku", "user", "workspace", "rate"]


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def _missing(*cols: str) -> Column:
    out = None
    for c in cols:
        m = _blank_to_null(F.col(c)).isNull() if c in ("sku", "workspace") else F.col(c).isNull()
        out = m if out is None else (out | m)
    return out


def _parsed_rows(parsed: DataFrame, *cols: Column) -> DataFrame:
    """The parsed row as the output of a one-row generator. A later filter on ``reason``
    (``valid``/``quarantine``) then stays above it instead of being pushed below the parse,
    where it would evaluate the parse a second time."""
    return parsed.select(F.inline(F.array(F.struct(*cols))))


def _payload(messages: DataFrame, reason: Column) -> list[Column]:
    """The message of a rejected row, as it came if the source kept its text (``raw``), else as JSON."""
    fields = [c for c in messages.columns if c not in ("ingest_at", "raw")]
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return [F.when(reason.isNotNull(), F.coalesce(F.col("raw"), whole) if "raw" in messages.columns else whole).alias("payload")]


def _position(messages: DataFrame) -> list[Column]:
    return [F.col("ingest_at")] if "ingest_at" in messages.columns else []


def parse_event_messages(messages: DataFrame, payload: bool = False) -> DataFrame:
    """V1/V4: typed usage events with a ``reason`` column (NULL = valid), and with ``payload`` the
    whole message of a rejected row.

    Times: ISO-8601 text, naive = UTC, offsets converted. Checks in order: uuid, missing
    fields, unparseable time, event_start > event_end, bad user (an empty user is NULL).
    Parsed values are computed once as columns; the checks read those columns."""
    parsed = messages.select(
        "*",
        canonical_uuid(F.col("uuid")).alias("_uid"),
        parse_ts(F.col("event_start")).alias("_start"),
        parse_ts(F.col("event_end")).alias("_end"),
        _blank_to_null(F.col("user")).alias("_user_raw"),
    ).withColumn("_user", canonical_uuid(F.col("_user_raw")))
    reason = (
        F.when(F.col("_uid").isNull(), F.lit("bad_uuid"))
        .when(_missing("sku", "workspace", "quantity", "event_start", "event_end"), F.lit("missing_field"))
        .when(F.col("_start").isNull() | F.col("_end").isNull(), F.lit("bad_time"))
        .when(F.col("_start") > F.col("_end"), F.lit("end_before_start"))
        .when(F.col("_user_raw").isNotNull() & F.col("_user").isNull(), F.lit("bad_user"))
    )
    return _parsed_rows(
        parsed,
        F.coalesce(F.col("_uid"), F.col("uuid")).alias("uuid"),
        F.col("_start").alias("event_start"),
        F.col("_end").alias("event_end"),
        F.col("sku"),
        F.col("_user").alias("user"),
        F.col("workspace"),
        F.col("quantity").cast("double").alias("quantity"),
        F.col("ingest_seq"),
        *_position(messages),
        reason.alias("reason"),
        *(_payload(messages, reason) if payload else []),
    )


def parse_sample_messages(messages: DataFrame, payload: bool = False) -> DataFrame:
    """V2: typed rate samples with a ``reason`` column (NULL = valid); ``payload`` as for events."""
    parsed = messages.select(
        "*",
        canonical_uuid(F.col("uuid")).alias("_uid"),
        parse_ts(F.col("sample_time")).alias("_t"),
        _blank_to_null(F.col("user")).alias("_user_raw"),
    ).withColumn("_user", canonical_uuid(F.col("_user_raw")))
    reason = (
        F.when(F.col("_uid").isNull(), F.lit("bad_uuid"))
        .when(_missing("sku", "workspace", "rate", "sample_time"), F.lit("missing_field"))
        .when(F.col("_t").isNull(), F.lit("bad_time"))
        .when(F.col("_user_raw").isNotNull() & F.col("_user").isNull(), F.lit("bad_user"))
    )
    return _parsed_rows(
        parsed,
        F.coalesce(F.col("_uid"), F.col("uuid")).alias("uuid"),
        F.col("_t").alias("sample_time"),
        F.col("sku"),
        F.col("_user").alias("user"),
        F.col("workspace"),
        F.col("rate").cast("double").alias("rate"),
        F.col("ingest_seq"),
        *_position(messages),
        reason.alias("reason"),
        *(_payload(messages, reason) if payload else []),
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "payload")


def quarantine(parsed: DataFrame) -> DataFrame:
    """V3: rejected rows with their reason; never retried. Rows parsed with their payload keep it, with
    its digest: two different bad messages are two rows also where neither has an id or a position."""
    kept = ["payload", F.sha2("payload", 256).alias("digest")] if "payload" in parsed.columns else []
    return parsed.filter(F.col("reason").isNotNull()).select("uuid", "ingest_seq", "reason", *kept)


def stub_item_id(sku: Column) -> Column:
    """Id of an item created for an unseen SKU; derived from the SKU so replays agree."""
    return md5_uuid(F.concat(F.lit("item:"), sku))


def stub_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """V6: one stub item (empty name and unit) per SKU seen in valid rows but not in items."""
    return (
        rows.select("sku")
        .distinct()
        .join(items.select("sku"), "sku", "left_anti")
        .select(stub_item_id(F.col("sku")).alias("uuid"), "sku", F.lit("").alias("name"), F.lit("").alias("unit"))
    )


def resolve_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """V5: SKU → item id (NULL when unknown). Items are one row per SKU."""
    it = measured_dim(items.select("sku", F.col("uuid").alias("item_id")), "sku-items")
    return rows.join(it, "sku", "left")


def first_wins(
    rows: DataFrame, key: str | list[str], stored: DataFrame | None = None, reason: str | None = None
) -> DataFrame:
    """Keep the earliest arrival (lowest ``ingest_at`` if the rows have it, else lowest
    ``ingest_seq``) per key, then drop keys already stored. ``row_number() = 1`` keeps one row per
    key and map task before the shuffle, so a repeated key does not concentrate its copies.

    With ``reason`` (parsed rows that still carry their reject reason) the earliest *valid*
    copy wins. Validity is tested after the window so the test is not pushed below the
    parse, which would evaluate the parse twice."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [(_position(rows) or [F.col("ingest_seq")])[0].asc()]
    if "ingest_at" in rows.columns:  # unnumbered messages may share a position: their content decides, also on a replay
        order.append(F.xxhash64(*[c for c in rows.columns if c != "ingest_at"]).asc())
    if reason is not None:
        order = [F.col(reason).isNotNull().asc()] + order
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_rn", F.row_number().over(w))
    cond = F.col("_rn") == 1
    if reason is not None:
        cond = cond & F.col(reason).isNull()
    first = first.filter(cond).drop("_rn", "ingest_at", "payload", *([reason] if reason else []))
    if stored is not None:
        first = first.join(stored.select(*keys), keys, "left_anti")
    return first


def ingest_events(
    messages: DataFrame | None, items: DataFrame, stored: DataFrame | None = None, parsed: DataFrame | None = None
) -> dict[str, DataFrame]:
    """R1 batch body: parse → validate → first wins → stub items → rows to append.

    Returns ``events`` (billing_event rows to append), ``stubs`` (items to add) and
    ``quarantine``. ``parsed``: the messages parsed already."""
    parsed = parse_event_messages(messages) if parsed is None else parsed
    good = first_wins(parsed, "uuid", stored, reason="reason")
    stubs = stub_items(good, items)
    with_item = resolve_items(good, items).withColumn(
        "item_id", F.coalesce(F.col("item_id"), stub_item_id(F.col("sku")))
    )
    events = with_item.select("uuid", "event_start", "event_end", "item_id", "user", "workspace", "quantity")
    return {"events": events, "stubs": stubs, "quarantine": quarantine(parsed)}


def ingest_samples(
    messages: DataFrame | None, items: DataFrame, stored: DataFrame | None = None, parsed: DataFrame | None = None
) -> dict[str, DataFrame]:
    """R3 batch body (storage part): samples to append, stub items, quarantine."""
    parsed = parse_sample_messages(messages) if parsed is None else parsed
    good = first_wins(parsed, "uuid", stored, reason="reason")
    stubs = stub_items(good, items)
    with_item = resolve_items(good, items).withColumn(
        "item_id", F.coalesce(F.col("item_id"), stub_item_id(F.col("sku")))
    )
    samples = with_item.select("uuid", "sample_time", "item_id", "user", "workspace", "rate")
    return {"samples": samples, "stubs": stubs, "quarantine": quarantine(parsed)}


def workspace_quarantine(messages: DataFrame, payload: bool = False) -> DataFrame:
    """V3 for workspace settings: messages without a name or with an account that is no id."""
    reason = F.when(_blank_to_null(F.col("name")).isNull(), F.lit("missing_field")).when(
        canonical_uuid(F.col("account")).isNull(), F.lit("bad_account")
    )
    kept = _payload(messages, reason) if payload else []
    bad = messages.select("name", "account", "ingest_seq", reason.alias("reason"), *kept).filter(F.col("reason").isNotNull())
    return bad.withColumn("digest", F.sha2("payload", 256)) if payload else bad


def workspace_map(messages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New (workspace, account) rows: first message per workspace wins and a
    workspace already mapped never moves. Messages: name, account, ingest_seq."""
    acc = canonical_uuid(F.col("account"))
    rows = messages.filter(acc.isNotNull() & _blank_to_null(F.col("name")).isNotNull()).select(
        F.col("name").alias("workspace"), acc.alias("account"), "ingest_seq", *_position(messages)
    )
    return first_wins(rows, "workspace", stored).select("workspace", "account")
