"""Registered queries: each reads the testdata tables of ``sf_dir`` (through the mapping in
``meterkit.sources.testmap``) and runs one operator of the library over the whole tables.

Float results that are sums are rounded to 4 places so that an independent SQL engine,
summing in another order, gives the same value; everything else is returned as computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterkit import schemas
from meterkit.functions import to_us
from meterkit.operators import access, catalog, ingest, timeseries, usage
from meterkit.session import ensure_utc
from meterkit.sources import testmap as tm
from meterkit.streaming import ingest_stream

# Fixed query parameters
WORKSPACE = "ws-7"
ACCOUNT_NATION = 10
PRINCIPAL = "user-10"
RANGE_START = "2024-01-10 00:00:00"
RANGE_END = "2024-02-20 00:00:00"
PAGE_SIZE = 100
AGG_PAGE_SIZE = 3
AGG_RANGE = ("2024-01-05 00:00:00", "2024-03-01 00:00:00")
SKU = "click"
PRICE_AT = "2024-01-15 00:00:00"
KNOWN_AT = "2024-01-11 12:00:00"
STORED_BEFORE = "2024-01-10 00:00:00"  # messages are de-duplicated against rows stored before this
RESUME_AS_OF = "2024-01-16 00:00:00"  # events recorded by then set the resume points
ESTIMATED_UNTIL = "2024-01-20 00:00:00"  # samples arrived when the stored estimates were made
CONFIGURED_AT = "2024-03-25 00:00:00"
UPTO = "2024-02-05 06:30:00"  # estimates close hours up to here


def _acct(n: int) -> str:
    import hashlib

    h = hashlib.md5(f"acct:{n}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


ACCOUNT = _acct(ACCOUNT_NATION)

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Q] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run

    return deco


def _r4(c):
    return F.round(c, 4)


def _events(spark, d):
    return tm.billing_event(spark, d)


def _items(spark, d):
    return tm.billing_item(spark, d)


def _usage(spark, d, **kw) -> DataFrame:
    return usage.usage_query(_events(spark, d), _items(spark, d), tm.workspace_account(spark, d), **kw)


# ------------------------------------------------------------------ usage


@register("usage_raw")
def usage_raw(spark, d):
    """Q1: every event with its SKU (inner join to items)."""
    return _usage(spark, d, limit=None)


@register("usage_by_workspace")
def usage_by_workspace(spark, d):
    """Q2: events of one workspace."""
    return _usage(spark, d, workspace=WORKSPACE, limit=None)


@register("usage_by_account")
def usage_by_account(spark, d):
    """Q3: events of the workspaces of one account."""
    return _usage(spark, d, account=ACCOUNT, limit=None)


@register("usage_range")
def usage_range(spark, d):
    """Q4: events contained in [start, end) (end exclusive on event_end)."""
    return _usage(spark, d, start=RANGE_START, end=RANGE_END, limit=None)


@register("usage_overlap")
def usage_overlap(spark, d):
    """Q4x (extension): events overlapping the range."""
    return _usage(spark, d, start=RANGE_START, end=RANGE_END, limit=None, mode="overlap")


@register("usage_page")
def usage_page(spark, d):
    """Q5/Q6: first page (API page size) in the complete order."""
    return _usage(spark, d, limit=PAGE_SIZE)


@register("usage_page_after")
def usage_page_after(spark, d):
    """Q7: second page, keyset cursor = last uuid of the first page."""
    first = _usage(spark, d, limit=PAGE_SIZE).select("uuid").collect()
    return _usage(spark, d, limit=PAGE_SIZE, after=first[-1]["uuid"])


@register("usage_page_foreign_cursor")
def usage_page_foreign_cursor(spark, d):
    """Q8: the cursor may name a row that the other filters leave out."""
    first = _usage(spark, d, limit=PAGE_SIZE).select("uuid").collect()
    return _usage(spark, d, workspace=WORKSPACE, limit=PAGE_SIZE, after=first[-1]["uuid"])


@register("usage_daily")
def usage_daily(spark, d):
    """A1: daily totals per workspace and item."""
    return _usage(spark, d, time_aggregation="day", limit=None).withColumn("quantity", _r4(F.col("quantity")))


@register("usage_monthly")
def usage_monthly(spark, d):
    """A2: monthly totals per workspace and item."""
    return _usage(spark, d, time_aggregation="month", limit=None).withColumn("quantity", _r4(F.col("quantity")))


@register("usage_daily_page")
def usage_daily_page(spark, d):
    """A3: page 2 of one workspace's daily totals within a range (cursor from page 1)."""
    kw = dict(workspace=WORKSPACE, start=AGG_RANGE[0], end=AGG_RANGE[1], time_aggregation="day", limit=AGG_PAGE_SIZE)
    first = _usage(spark, d, **kw).select("uuid").collect()
    return _usage(spark, d, after=first[-1]["uuid"], **kw).withColumn("quantity", _r4(F.col("quantity")))


@register("usage_export")
def usage_export(spark, d):
    """One workspace's usage as API rows."""
    return usage.usage_export(_usage(spark, d, workspace=WORKSPACE, limit=None))


@register("latest_event")
def latest_event(spark, d):
    """Q9: latest event per workspace and item."""
    return usage.latest_events(_events(spark, d))


@register("earliest_sample")
def earliest_sample(spark, d):
    """Q10: earliest sample per workspace and item."""
    return usage.earliest_samples(tm.rate_sample(spark, d))


@register("compact_daily")
def compact_daily(spark, d):
    """A5 (extension): events merged per user, workspace, item and day."""
    return usage.compact_daily(_events(spark, d)).withColumn("quantity", _r4(F.col("quantity")))


@register("split_midnight")
def split_midnight(spark, d):
    """A6 (extension): events cut at UTC midnight, quantity pro-rated."""
    return usage.split_midnight(_events(spark, d)).withColumn("quantity", _r4(F.col("quantity")))


# ------------------------------------------------------------------ time series


@register("interval_samples")
def interval_samples(spark, d):
    """The samples used for each requested interval."""
    return timeseries.interval_samples(tm.rate_sample(spark, d), tm.requested_intervals(spark, d))


@register("rate_at")
def rate_at(spark, d):
    """Interpolated rate at the start of each requested interval (NULL outside the signal)."""
    iv = tm.requested_intervals(spark, d).select("interval_id", *timeseries.KEYS, to_us(F.col("start")).alias("x"))
    return timeseries.rates_at(tm.rate_sample(spark, d), iv, "x").select("interval_id", F.round("rate", 6).alias("rate"))


@register("consumption_interval")
def consumption_interval(spark, d):
    """Interpolate-and-integrate consumption for each requested interval."""
    out = timeseries.consumption_for_intervals(tm.rate_sample(spark, d), tm.requested_intervals(spark, d))
    return out.select("interval_id", "workspace", "item_id", "start", "end", _r4(F.col("consumption")).alias("consumption"))


def _estimates(spark, d, samples=None, resume=None) -> DataFrame:
    s = samples if samples is not None else tm.rate_sample(spark, d)
    out = timeseries.hourly_estimates(s, _items(spark, d), resume=resume)
    return out.select("uuid", "workspace", "item_id", "sku", "event_start", "event_end", "quantity")


@register("hourly_estimates")
def hourly_estimates(spark, d):
    """T4/T5: hourly estimated events for every workspace and SKU from all samples."""
    return _estimates(spark, d).withColumn("quantity", _r4(F.col("quantity")))


@register("estimate_ids")
def estimate_ids(spark, d):
    """T5: deterministic estimate id of each event's (workspace, SKU, start)."""
    ev = usage.with_sku(_events(spark, d), _items(spark, d))
    return ev.select(
        "uuid", timeseries.estimate_id(F.col("workspace"), F.col("sku"), F.col("event_start")).alias("estimate_id")
    )


@register("resume_points")
def resume_points(spark, d):
    """Where estimation continues per key with samples."""
    return timeseries.resume_points(tm.rate_sample(spark, d), _events(spark, d))


@register("resume_estimates")
def resume_estimates(spark, d):
    """T4+T6: estimates continuing from the events recorded as of a time (partial first
    windows, zero windows before the first sample)."""
    prior = _events(spark, d).filter(F.col("event_end") <= F.lit(RESUME_AS_OF).cast("timestamp_ntz"))
    samples = tm.rate_sample(spark, d)
    resume = timeseries.resume_points(samples, prior)
    return _estimates(spark, d, samples, resume).withColumn("quantity", _r4(F.col("quantity")))


@register("estimate_drift")
def estimate_drift(spark, d):
    """R5 audit: estimates made when only samples before a time were known, compared with
    a recompute over all samples."""
    arrivals = tm.sample_arrivals(spark, d)
    # only keys touched by late data can drift; both runs are restricted to them
    touched = timeseries.late_keys(arrivals, "arrived_at", ESTIMATED_UNTIL)
    arrivals = arrivals.join(touched, timeseries.KEYS, "left_semi")
    samples = arrivals.drop("arrived_at")
    early = arrivals.filter(F.col("arrived_at") < F.lit(ESTIMATED_UNTIL).cast("timestamp_ntz")).drop("arrived_at")
    stored = _estimates(spark, d, early)
    now = _estimates(spark, d, samples)
    # windows that were not closed yet when the estimates were stored are no drift
    drift = timeseries.estimate_drift(stored, now, tolerance=1e-6, missing="recomputed")
    return drift.select(
        "uuid",
        "workspace",
        "item_id",
        "event_start",
        _r4(F.col("stored_quantity")).alias("stored_quantity"),
        _r4(F.col("recomputed_quantity")).alias("recomputed_quantity"),
    )


# ------------------------------------------------------------------ items and prices


@register("items")
def items(spark, d):
    """Items in SKU order."""
    return catalog.list_items(_items(spark, d))


@register("item_by_sku")
def item_by_sku(spark, d):
    """One item by SKU."""
    return catalog.item_by_sku(_items(spark, d), SKU)


@register("prices_at")
def prices_at(spark, d):
    """All price rows valid at a time."""
    return catalog.prices_at(tm.billing_item_price(spark, d), _items(spark, d), PRICE_AT)


@register("effective_price")
def effective_price(spark, d):
    """C4 (extension): effective price per SKU at a time (latest configured wins)."""
    return catalog.effective_prices(tm.billing_item_price(spark, d), _items(spark, d), PRICE_AT)


@register("price_known_at")
def price_known_at(spark, d):
    """C7 (extension): effective price as known at an earlier configuration time."""
    return catalog.effective_prices(tm.billing_item_price(spark, d), _items(spark, d), PRICE_AT, known_at=KNOWN_AT)


def _priced(spark, d):
    return catalog.price_usage(_events(spark, d), tm.billing_item_price(spark, d))


@register("priced_usage")
def priced_usage(spark, d):
    """C5 (extension): every event priced at its start."""
    return _priced(spark, d)


@register("account_charges")
def account_charges(spark, d):
    """C6 (extension): charges per account and month."""
    return catalog.account_charges(_priced(spark, d), tm.workspace_account(spark, d))


def _item_config(spark, d) -> DataFrame:
    it = _items(spark, d).select("sku")
    even = F.length("sku") % 2 == 0
    changed = it.select(
        "sku",
        F.when(even, F.upper("sku")).alias("name"),
        F.when(~even, F.lit("unit-h")).alias("unit"),
    )
    added = it.select(
        F.concat(F.lit("cfg-"), F.col("sku")).alias("sku"),
        F.concat(F.lit("Config "), F.col("sku")).alias("name"),
        F.lit("unit-m").alias("unit"),
    )
    return changed.unionByName(added)


@register("item_upsert")
def item_upsert(spark, d):
    """Items after applying a configuration (update present fields, insert new)."""
    return catalog.upsert_items(_items(spark, d), _item_config(spark, d))


@register("item_upsert_repeated")
def item_upsert_repeated(spark, d):
    """A configuration that names SKUs several times; the last value of each field counts."""
    once = _item_config(spark, d).withColumn("seq", F.lit(1))
    again = once.select("sku", F.lit(None).cast("string").alias("name"), F.lit("unit-d").alias("unit"), F.lit(2).alias("seq"))
    more = once.select("sku", F.concat(F.lit("Last "), F.col("sku")).alias("name"), F.lit(None).cast("string").alias("unit"), F.lit(3).alias("seq"))
    return catalog.upsert_items(_items(spark, d), once.unionByName(again).unionByName(more))


@register("price_check")
def price_check(spark, d):
    """V4: price rows whose range ends before it starts (every row of the table is turned round;
    open ones stay valid)."""
    p = tm.billing_item_price(spark, d)
    turned = p.select("uuid", F.coalesce("valid_until", "valid_from").alias("valid_from"), F.when(F.col("valid_until").isNotNull(), F.col("valid_from")).alias("valid_until"))
    return catalog.price_violations(turned)


@register("items_export")
def items_export(spark, d):
    """API rows of items."""
    return usage.items_export(_items(spark, d))


@register("prices_export")
def prices_export(spark, d):
    """API rows of the prices in force at a time."""
    return usage.prices_export(catalog.prices_at(tm.billing_item_price(spark, d), _items(spark, d), PRICE_AT))


def _price_config(spark, d, bad: bool) -> DataFrame:
    it = _items(spark, d).select("sku")
    L = F.length("sku").cast("double")

    def row(seq, sku, vf, price):
        return it.select(
            F.lit(seq).alias("seq"), sku.alias("sku"), F.lit(vf).cast("timestamp_ntz").alias("valid_from"), price.alias("price")
        )

    rows = [
        row(1, F.col("sku"), "2024-03-21 00:00:00", F.lit(9.99)),
        row(2, F.col("sku"), "2024-04-01 00:00:00", L),
        row(3, F.col("sku"), "2024-01-11 00:00:00", F.lit(1.5)),
        row(4, F.col("sku"), "2024-04-01 00:00:00", L + 0.5),
        row(5, F.col("sku"), "2024-04-15 00:00:00", F.lit(2.0)),
    ]
    if bad:
        rows += [
            row(6, F.concat(F.lit("nosuch-"), F.col("sku")), "2024-05-01 00:00:00", F.lit(1.0)),
            row(7, F.col("sku"), "2024-02-05 00:00:00", F.lit(3.0)),
        ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    # rows of one SKU apply in seq order; rows of different SKUs are independent
    return out


@register("price_upsert")
def price_upsert(spark, d):
    """Price table after a configuration load that overwrites and appends."""
    table, _ = catalog.apply_price_config(
        tm.billing_item_price(spark, d), _items(spark, d), _price_config(spark, d, bad=False), CONFIGURED_AT
    )
    return table


@register("price_rejects")
def price_rejects(spark, d):
    """Rejected rows of a load with an unknown SKU and a backdated price."""
    return catalog.price_rejects(tm.billing_item_price(spark, d), _items(spark, d), _price_config(spark, d, bad=True)).drop(
        "seq"
    )


# ------------------------------------------------------------------ ingest


def _stored_events(spark, d):
    return _events(spark, d).filter(F.col("event_end") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))


@register("ingest_events")
def ingest_events(spark, d):
    """Parsed, valid usage-event messages (all copies)."""
    return ingest.valid(ingest.parse_event_messages(tm.event_messages(spark, d)))


@register("event_quarantine")
def event_quarantine(spark, d):
    """V3/V4: rejected usage-event messages with reasons."""
    return ingest.quarantine(ingest.parse_event_messages(tm.event_messages(spark, d)))


@register("quarantine_bad_times")
def quarantine_bad_times(spark, d):
    """F2/V1: a time text must name a whole date, extended or basic."""
    return ingest.parse_event_messages(tm.time_text_messages(spark, d)).select("uuid", "event_start", "event_end", "reason")


@register("workspace_quarantine")
def workspace_quarantine(spark, d):
    """Rejected workspace-settings messages with reasons."""
    return ingest.workspace_quarantine(tm.workspace_messages_with_errors(spark, d))


@register("quarantine_repair")
def quarantine_repair(spark, d):
    """V3: messages that end before they start, read back from the payload that quarantine keeps, with
    their ends swapped, and parsed again."""
    rejected = ingest.quarantine(ingest.parse_event_messages(tm.event_messages(spark, d), payload=True))
    back = ingest_stream.letters(rejected, schemas.EVENT_MESSAGE).filter("reason = 'end_before_start'").drop("reason", "digest")
    fixed = back.select("uuid", F.col("event_end").alias("event_start"), F.col("event_start").alias("event_end"), "sku", "user", "workspace", "quantity", "ingest_seq")
    return ingest.valid(ingest.parse_event_messages(fixed))


@register("ingest_events_json")
def ingest_events_json(spark, d):
    """Broker messages, JSON text in binary values, parsed and validated (all copies)."""
    m = tm.event_messages(spark, d)
    fields = [c for c in m.columns if c != "ingest_seq"]
    raw = m.select(
        F.encode(F.to_json(F.struct(*fields)), "UTF-8").alias("value"),
        F.timestamp_millis(F.lit(1_735_689_600_000)).alias("timestamp"), F.lit(0).alias("partition"), F.col("ingest_seq").alias("offset"),
    )
    rows = ingest_stream.broker_messages(raw, schemas.EVENT_MESSAGE)
    return ingest.valid(ingest.parse_event_messages(rows, payload=True)).drop("ingest_seq", "ingest_at")


@register("stream_events_replay")
def stream_events_replay(spark, d):
    """Resume points asked for by a batch in which stored uuids and re-sent copies with other
    ends occur; only rows as kept count."""
    out = ingest_stream.event_arrivals(tm.event_messages(spark, d), _items(spark, d), _stored_events(spark, d))
    return ingest_stream.resume_moves(out["accepted"]).withColumnRenamed("_end", "resume_at")


@register("stream_samples_replay")
def stream_samples_replay(spark, d):
    """The samples that a batch's estimates are made from: stored copies, else first arrivals."""
    stored = tm.rate_sample(spark, d).filter(F.col("sample_time") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
    return ingest_stream.sample_arrivals(tm.sample_messages(spark, d), _items(spark, d), stored)["accepted"]


@register("estimates_upto")
def estimates_upto(spark, d):
    """With an explicit closing time every key's hours run up to it, with 0 after its last sample."""
    samples = tm.rate_sample(spark, d)
    upto = samples.select(*timeseries.KEYS).distinct().withColumn("upto", F.lit(UPTO).cast("timestamp_ntz"))
    est = timeseries.hourly_estimates(samples, upto=upto)
    return est.groupBy(*timeseries.KEYS).agg(F.count("*").alias("windows"), F.max("event_end").alias("until"), F.round(F.sum("quantity"), 2).alias("quantity"))


@register("events_resolved")
def events_resolved(spark, d):
    """V5: valid messages with their item id (NULL when the SKU is unknown)."""
    good = ingest.valid(ingest.parse_event_messages(tm.event_messages(spark, d)))
    return ingest.resolve_items(good, _items(spark, d)).select("uuid", "sku", "item_id", "ingest_seq")


@register("stub_items")
def stub_items(spark, d):
    """V6: stub items for SKUs seen in valid messages but not configured."""
    good = ingest.valid(ingest.parse_event_messages(tm.event_messages(spark, d)))
    return ingest.stub_items(good, _items(spark, d))


@register("dedup_events")
def dedup_events(spark, d):
    """Events appended by an ingest: first arrival per uuid, not already stored."""
    return ingest.ingest_events(tm.event_messages(spark, d), _items(spark, d), _stored_events(spark, d))["events"]


@register("ingest_samples")
def ingest_samples(spark, d):
    """S3/V2: parsed, valid rate-sample messages (all copies)."""
    return ingest.valid(ingest.parse_sample_messages(tm.sample_messages(spark, d)))


@register("dedup_samples")
def dedup_samples(spark, d):
    """Samples appended by an ingest: first arrival per uuid, not already stored."""
    stored = tm.rate_sample(spark, d).filter(F.col("sample_time") < F.lit(STORED_BEFORE).cast("timestamp_ntz"))
    return ingest.ingest_samples(tm.sample_messages(spark, d), _items(spark, d), stored)["samples"]


@register("workspace_map")
def workspace_map(spark, d):
    """Workspace → account rows added by the settings messages (first wins)."""
    return ingest.workspace_map(tm.workspace_messages(spark, d), tm.workspace_account(spark, d))


# ------------------------------------------------------------------ access


def _usage_rows(spark, d):
    return usage.with_sku(_events(spark, d), _items(spark, d)).select(*usage.EVENT_COLUMNS)


@register("visible_usage")
def visible_usage(spark, d):
    """Usage rows a principal may read as workspace member or owner."""
    return access.visible_usage(_usage_rows(spark, d), tm.entitlements(spark, d), PRINCIPAL)


@register("owned_usage")
def owned_usage(spark, d):
    """Usage rows of workspaces the principal owns."""
    return access.visible_usage(_usage_rows(spark, d), tm.entitlements(spark, d), PRINCIPAL, require_owner=True)


@register("visible_account_usage")
def visible_account_usage(spark, d):
    """Usage rows of the accounts the principal owns."""
    return access.visible_account_usage(
        _usage_rows(spark, d), tm.workspace_account(spark, d), tm.entitlements(spark, d), PRINCIPAL
    )


@register("admin_usage")
def admin_usage(spark, d):
    """X1 admin bypass: the hub admin reads every usage row."""
    return access.visible_usage(_usage_rows(spark, d), tm.entitlements(spark, d), "user-0", allow_hub_admin=True)


def queries() -> dict[str, Q]:
    return dict(REGISTRY)


__all__ = ["queries"]
