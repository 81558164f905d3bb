"""Maps the driver's testdata tables onto the metering tables (FIXTURES.md part 2).

Every function reads the given parquet tables and derives its rows with column
expressions, so the work grows with the input. ``U(x)`` = ``md5_uuid(x)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit.functions import DAY_US, HOUR_US, SECOND_US, from_us, md5_uuid, to_us

PRICE_TYPE = "decimal(38,12)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _u(prefix: str, col: Column) -> Column:
    return md5_uuid(F.concat(F.lit(prefix), col.cast("string")))


def _user(event_id: Column, user_id: Column) -> Column:
    return F.when(event_id % 5 == 0, F.lit(None).cast("string")).otherwise(_u("u:", user_id))


def _shifted_start_us(event_id: Column, ts: Column) -> Column:
    # three months of data: the event month moves by 0, 30 or 60 days
    return to_us(ts) + (event_id % 3) * F.lit(30 * DAY_US)


def _end_us(event_id: Column, start_us: Column) -> Column:
    return start_us + (event_id % 13) * F.lit(600 * SECOND_US)


def billing_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    skus = read(spark, sf_dir, "events").select(F.col("event_type").alias("sku")).distinct()
    return skus.select(
        _u("item:", F.col("sku")).alias("uuid"),
        "sku",
        F.concat(F.lit("Item "), F.col("sku")).alias("name"),
        F.lit("unit-s").alias("unit"),
    )


def billing_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start_us = _shifted_start_us(F.col("event_id"), F.col("ts"))
    return e.select(
        _u("ev:", F.col("event_id")).alias("uuid"),
        from_us(start_us).alias("event_start"),
        from_us(_end_us(F.col("event_id"), start_us)).alias("event_end"),
        _u("item:", F.col("event_type")).alias("item_id"),
        _user(F.col("event_id"), F.col("user_id")).alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("quantity"),
    )


def rate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        _u("rs:", F.col("event_id")).alias("uuid"),
        F.col("ts").alias("sample_time"),
        _u("item:", F.col("event_type")).alias("item_id"),
        _user(F.col("event_id"), F.col("user_id")).alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("rate"),
    )


def sample_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rate_sample`` plus ``arrived_at``: every 17th sample arrives two days late."""
    e = read(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 17 == 0, F.lit(2 * DAY_US)).otherwise(F.lit(0))
    return e.select(
        _u("rs:", F.col("event_id")).alias("uuid"),
        F.col("ts").alias("sample_time"),
        _u("item:", F.col("event_type")).alias("item_id"),
        _user(F.col("event_id"), F.col("user_id")).alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("rate"),
        from_us(to_us(F.col("ts")) + late).alias("arrived_at"),
    )


def _message_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events once (ingest_seq 2·id) plus a later re-send of every 7th id (2·id+1)."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    first = e.withColumn("ingest_seq", F.col("event_id") * 2)
    again = (
        e.filter(F.col("event_id") % 7 == 0)
        .withColumn("value", F.col("value") + 100)
        .withColumn("ingest_seq", F.col("event_id") * 2 + 1)
    )
    return first.unionByName(again)


def _iso_text(event_id: Column, us: Column) -> Column:
    """Naive ISO text for even ids, explicit ``+00:00`` for odd ids."""
    base = F.date_format(from_us(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(event_id % 2 == 1, F.concat(base, F.lit("+00:00"))).otherwise(base)


def _message_user(event_id: Column, user_id: Column) -> Column:
    return F.when(event_id % 10 == 0, F.lit("")).otherwise(_user(event_id, user_id))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage-event messages as text fields, with duplicates, bad ids, bad ranges and new SKUs."""
    m = _message_copies(spark, sf_dir)
    eid = F.col("event_id")
    start_us = _shifted_start_us(eid, F.col("ts"))
    # a re-sent copy (odd ingest_seq) also claims another end
    resent = F.when(F.col("ingest_seq") % 2 == 1, F.lit(8 * HOUR_US)).otherwise(F.lit(0))
    end_us = F.when(eid % 103 == 0, start_us - F.lit(HOUR_US)).otherwise(_end_us(eid, start_us) + resent)
    return m.select(
        F.when(eid % 101 == 0, F.concat(F.lit("bad-"), eid.cast("string"))).otherwise(_u("ev:", eid)).alias("uuid"),
        _iso_text(eid, start_us).alias("event_start"),
        _iso_text(eid, end_us).alias("event_end"),
        F.when(eid % 11 == 0, F.concat(F.lit("new-"), F.col("event_type"))).otherwise(F.col("event_type")).alias("sku"),
        _message_user(eid, F.col("user_id")).alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("quantity"),
        F.col("ingest_seq"),
    )


def sample_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-sample messages as text fields, with the same defects as ``event_messages``."""
    m = _message_copies(spark, sf_dir)
    eid = F.col("event_id")
    resent = F.when(F.col("ingest_seq") % 2 == 1, F.lit(4 * HOUR_US)).otherwise(F.lit(0))
    return m.select(
        F.when(eid % 101 == 0, F.concat(F.lit("bad-"), eid.cast("string"))).otherwise(_u("rs:", eid)).alias("uuid"),
        _iso_text(eid, to_us(F.col("ts")) + resent).alias("sample_time"),
        F.when(eid % 11 == 0, F.concat(F.lit("new-"), F.col("event_type"))).otherwise(F.col("event_type")).alias("sku"),
        _message_user(eid, F.col("user_id")).alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("rate"),
        F.col("ingest_seq"),
    )


def workspace_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored map; every tenth customer is left out so some workspaces are unmapped."""
    c = read(spark, sf_dir, "customer")
    return c.filter(F.col("c_custkey") % 10 != 9).select(
        F.concat(F.lit("ws-"), F.col("c_custkey").cast("string")).alias("workspace"),
        _u("acct:", F.col("c_nationkey")).alias("account"),
    )


def workspace_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace-settings messages: one per customer, plus a later attempt to move every fourth."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = c.select(
        F.concat(F.lit("ws-"), F.col("c_custkey").cast("string")).alias("name"),
        _u("acct:", F.col("c_nationkey")).alias("account"),
        (F.col("c_custkey") * 2).alias("ingest_seq"),
    )
    moved = c.filter(F.col("c_custkey") % 4 == 0).select(
        F.concat(F.lit("ws-"), F.col("c_custkey").cast("string")).alias("name"),
        _u("acct:", (F.col("c_nationkey") + 1) % 25).alias("account"),
        (F.col("c_custkey") * 2 + 1).alias("ingest_seq"),
    )
    return first.unionByName(moved)


def billing_item_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine consecutive 10-day prices per SKU (the last open) plus one later-configured correction."""
    items = billing_item(spark, sf_dir).select(F.col("uuid").alias("item_id"), "sku")
    k = F.col("k")
    base_us = to_us(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    valid_from_us = base_us + k * F.lit(10 * DAY_US)
    steps = items.select("item_id", "sku", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    regular = steps.select(
        md5_uuid(F.concat(F.lit("price:"), F.col("sku"), F.lit(":"), k.cast("string"))).alias("uuid"),
        "item_id",
        ((k + 1) * F.length("sku") / F.lit(100.0)).cast(PRICE_TYPE).alias("price"),
        from_us(valid_from_us).alias("valid_from"),
        F.when(k < 8, from_us(valid_from_us + F.lit(10 * DAY_US))).alias("valid_until"),
        from_us(valid_from_us).alias("configured_at"),
    )
    corr_from = base_us + F.lit(10 * DAY_US)
    correction = items.select(
        md5_uuid(F.concat(F.lit("price:"), F.col("sku"), F.lit(":c"))).alias("uuid"),
        "item_id",
        ((2 * F.length("sku") + 1) / F.lit(100.0)).cast(PRICE_TYPE).alias("price"),
        from_us(corr_from).alias("valid_from"),
        from_us(corr_from + F.lit(10 * DAY_US)).alias("valid_until"),
        from_us(corr_from + F.lit(DAY_US)).alias("configured_at"),
    )
    return regular.unionByName(correction)


def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access rows (principal, kind, target, role): workspace members/owners, account owners, admins."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ws = c.select(
        F.concat(F.lit("user-"), F.col("c_nationkey").cast("string")).alias("principal"),
        F.lit("workspace").alias("kind"),
        F.concat(F.lit("ws-"), F.col("c_custkey").cast("string")).alias("target"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("owner")).otherwise(F.lit("member")).alias("role"),
    )
    acct = (
        c.select("c_nationkey")
        .distinct()
        .select(
            F.concat(F.lit("user-"), F.col("c_nationkey").cast("string")).alias("principal"),
            F.lit("account").alias("kind"),
            _u("acct:", F.col("c_nationkey")).alias("target"),
            F.lit("owner").alias("role"),
        )
    )
    admin = (
        c.filter(F.col("c_nationkey") == 0)
        .select(
            F.concat(F.lit("user-"), F.col("c_nationkey").cast("string")).alias("principal"),
            F.lit("global").alias("kind"),
            F.lit(None).cast("string").alias("target"),
            F.lit("hub_admin").alias("role"),
        )
        .distinct()
    )
    return ws.unionByName(acct).unionByName(admin)


def requested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per event: [ts − 90 min, ts + 45 min] for the event's workspace and SKU."""
    e = read(spark, sf_dir, "events")
    t = to_us(F.col("ts"))
    return e.select(
        _u("iv:", F.col("event_id")).alias("interval_id"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        _u("item:", F.col("event_type")).alias("item_id"),
        from_us(t - F.lit(90 * 60 * SECOND_US)).alias("start"),
        from_us(t + F.lit(45 * 60 * SECOND_US)).alias("end"),
    )


def time_text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage-event messages whose start comes in five spellings, by event id: ISO, basic ISO, and
    clock only, year only, month only, which name no time."""
    e = read(spark, sf_dir, "events")
    eid, us = F.col("event_id"), to_us(F.col("ts"))
    spelled = (
        F.when(eid % 5 == 0, F.date_format(from_us(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(eid % 5 == 1, F.date_format(from_us(us), "yyyyMMdd'T'HHmmss'Z'"))
        .when(eid % 5 == 2, F.date_format(from_us(us), "HH:mm:ss"))
        .when(eid % 5 == 3, F.date_format(from_us(us), "yyyy"))
        .otherwise(F.date_format(from_us(us), "yyyy-MM"))
    )
    return e.select(
        _u("ev:", eid).alias("uuid"),
        spelled.alias("event_start"),
        F.date_format(from_us(us + F.lit(DAY_US)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_end"),
        F.col("event_type").alias("sku"),
        F.lit(None).cast("string").alias("user"),
        F.concat(F.lit("ws-"), F.col("user_id").cast("string")).alias("workspace"),
        F.col("value").alias("quantity"),
        eid.alias("ingest_seq"),
    )


def workspace_messages_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace-settings messages, some without a name and some with an account that is no id."""
    m = workspace_messages(spark, sf_dir)
    seq = F.col("ingest_seq")
    return m.select(
        F.when(seq % 13 == 0, F.lit(" ")).otherwise(F.col("name")).alias("name"),
        F.when(seq % 17 == 0, F.lit("no-account")).otherwise(F.col("account")).alias("account"),
        "ingest_seq",
    )
