"""Usage queries over billing events: filter, account join, range, order, top-k, keyset paging,
day/month totals, daily compaction, midnight split, latest/earliest lookups and export.

All functions return lazy DataFrames. The only driver actions are the single-row cursor
lookup of ``usage_query(after=...)`` and, where the planner takes the items for large, storing
their ids and SKUs (``dims.measured_dim``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.functions import DAY_US, floor_div, from_us, iso_z, to_us
from meterkit.operators.dims import measured_dim, small_dim

ORDER_KEYS = ["event_start", "event_end", "workspace", "sku", "uuid"]
EVENT_COLUMNS = ["uuid", "event_start", "event_end", "item_id", "sku", "user", "workspace", "quantity"]
API_PAGE_SIZE = 100  # page size when a caller passes 0 or nothing at the API edge
FUNCTION_PAGE_SIZE = 5_000  # page size of the library call


class CursorNotFound(LookupError):
    """The ``after`` cursor names no row of the (possibly aggregated) source."""


def with_sku(events: DataFrame, items: DataFrame) -> DataFrame:
    """Q1: inner join to items; events whose item is unknown are dropped."""
    return _with_sku(events, sku_dim(items))


def sku_dim(items: DataFrame) -> DataFrame:
    """(item_id, sku) of the items, broadcast where it is small in fact."""
    return measured_dim(items.select(F.col("uuid").alias("item_id"), "sku"), "item-skus")


def _with_sku(events: DataFrame, skus: DataFrame) -> DataFrame:
    return events.join(skus, "item_id", "inner")


def period_bounds(ts: Column, period: str) -> tuple[Column, Column]:
    """UTC day or month bucket [start, end) containing ``ts``."""
    if period == "day":
        start_us = floor_div(to_us(ts), DAY_US) * F.lit(DAY_US)
        return from_us(start_us), from_us(start_us + F.lit(DAY_US))
    if period == "month":
        first = F.trunc(ts.cast("date"), "month")
        return first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")
    raise ValueError(f"unknown time aggregation {period!r}")


def spark_period(spark, ts, period: str) -> tuple[dt.datetime, dt.datetime]:
    """The day or month that holds ``ts`` (text or a time)."""
    at = F.lit(ts).cast("timestamp_ntz")
    return tuple(spark.range(1).select(*period_bounds(at, period)).first())


def period_end(start: dt.datetime, period: str) -> dt.datetime:
    """The end of the day or month that begins at ``start``."""
    if period == "day":
        return start + dt.timedelta(days=1)
    return (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)


def aggregate_usage(events: DataFrame, period: str) -> DataFrame:
    """A1/A2: totals per (period, item, workspace); uuid is the largest uuid text of the group,
    user is NULL. An event counts wholly in the period of its start."""
    start, _ = period_bounds(F.col("event_start"), period)
    grouped = events.groupBy(start.alias("event_start"), "item_id", "workspace").agg(
        F.max("uuid").alias("uuid"), F.sum("quantity").alias("quantity")
    )
    return grouped.select(
        "uuid",
        "event_start",
        period_bounds(F.col("event_start"), period)[1].alias("event_end"),
        "item_id",
        F.lit(None).cast("string").alias("user"),
        "workspace",
        "quantity",
    )


def _keyset_after(df: DataFrame, cursor: dict) -> DataFrame:
    """Q7: rows strictly after ``cursor`` in ORDER_KEYS order.

    The leading bound ``event_start >= cursor`` is redundant but reaches the Parquet scan;
    a struct comparison would not."""
    later = F.lit(False)
    for key in reversed(ORDER_KEYS):
        here = F.lit(cursor[key])
        later = (F.col(key) > here) | ((F.col(key) == here) & later)
    return df.filter((F.col(ORDER_KEYS[0]) >= F.lit(cursor[ORDER_KEYS[0]])) & later)


def page_size(limit: int | None) -> int:
    """Q6: the page size of an API call; 0 or nothing means the default."""
    return limit or API_PAGE_SIZE


def _find_cursor(source, skus: DataFrame, after, period: str | None) -> dict:
    """Q8: the order keys of the row named by ``after``, looked up among all rows, whatever the
    other filters are. A store finds the uuid through its ledger. An aggregated row's uuid is that
    of one of its events, so only that event's own group is aggregated. A row of an earlier page
    (a Row or dict with the order keys) is its own cursor and is not looked up."""
    if not isinstance(after, str):
        keys = after.asDict() if hasattr(after, "asDict") else dict(after)
        return {k: keys[k] for k in ORDER_KEYS}
    stored = not isinstance(source, DataFrame)
    row = source.find("billing_event", after) if stored else source.filter(F.col("uuid") == after)
    if period is not None:
        start, _ = period_bounds(F.col("event_start"), period)
        event = row.select(start.alias("start"), "item_id", "workspace").limit(1).collect()
        if event:
            g = event[0]
            lo, hi = period_bounds(F.lit(g.start), period)
            group = source.read("billing_event", time_from=g.start, time_until=period_end(g.start, period)) if stored else source
            group = group.filter((start == F.lit(g.start)) & F.col("item_id").eqNullSafe(g.item_id) & F.col("workspace").eqNullSafe(g.workspace))
            group = group.filter((F.col("event_start") >= lo) & (F.col("event_start") < hi))
            row = aggregate_usage(group, period).filter(F.col("uuid") == after)
    found = _with_sku(row, skus).select(*ORDER_KEYS).limit(1).collect()
    if not found:
        raise CursorNotFound(f"No records matching after={after} found")
    return found[0].asDict()


def usage_query(
    events,
    items: DataFrame,
    accounts: DataFrame | None = None,
    *,
    workspace: str | None = None,
    account: str | None = None,
    start=None,
    end=None,
    after=None,
    limit: int | None = FUNCTION_PAGE_SIZE,
    time_aggregation: str | None = None,
    mode: str = "contained",
    ordered: bool | None = None,
) -> DataFrame:
    """Q1–Q8 and A1–A3: the usage query with all its facets.

    ``start``/``end`` select events contained in the range (``event_start >= start`` and
    ``event_end < end``); ``mode="overlap"`` selects events overlapping it instead (Q4x).
    With ``time_aggregation`` the filters, order, limit and cursor apply to the aggregated
    rows. ``events`` is the event table, or a ``TableStore`` or ``Snapshot`` holding it, whose month
    partitions the range then prunes; pages of one pinned snapshot agree with each other. ``after``
    is the uuid of an earlier row, or that row itself (no look-up). ``limit=None`` returns every matching row (a bare call returns one page); it is sorted only with ``ordered=True``
    (a full sort of a fact table is a range shuffle of all of it, so it is opt-in when no
    page size bounds the result).
    """
    if time_aggregation in (None, ""):
        period = None
    elif time_aggregation in ("day", "month"):
        period = time_aggregation
    else:
        raise ValueError(f"time_aggregation must be 'day', 'month' or empty, not {time_aggregation!r}")
    if mode not in ("contained", "overlap"):
        raise ValueError(f"unknown range mode {mode!r}")

    start_c = F.lit(start).cast("timestamp_ntz") if start is not None else None
    end_c = F.lit(end).cast("timestamp_ntz") if end is not None else None

    columns = ["uuid", "event_start", "event_end", "item_id", "user", "workspace", "quantity"]
    if isinstance(events, DataFrame):
        source = raw = events.select(*columns)
    else:
        # a table store: the range prunes partitions. An event that overlaps it ends after its start;
        # an aggregated row does with its whole period, so its events start in the periods that meet it
        source = events.snapshot() if hasattr(events, "snapshot") else events
        if mode == "contained":
            bounds = {"time_from": start, "time_until": end}
        elif period is None:
            bounds = {"time_until": end, "ends_after": start}
        else:
            lo, hi = (None if x is None else spark_period(source.spark, x, period) for x in (start, end))
            bounds = {"time_from": lo and lo[0], "time_until": hi and hi[1]}
        raw = source.read("billing_event", **bounds).select(*columns)
    # workspace and account are grouping keys, so filtering raw rows first is exact
    if workspace is not None:
        raw = raw.filter(F.col("workspace") == workspace)
    if account is not None:
        if accounts is None:
            raise ValueError("account filter needs the workspace_account table")
        acc = accounts.filter(F.col("account") == account).select("workspace")
        raw = raw.join(small_dim(acc), "workspace", "left_semi")

    if period is None:
        src = raw
    else:
        # bounds on aggregated rows imply bounds on the raw rows of every surviving group;
        # adding them below the aggregate lets them reach the scan
        if mode == "contained":
            if start_c is not None:
                raw = raw.filter(F.col("event_start") >= start_c)
            if end_c is not None:
                raw = raw.filter(F.col("event_start") < end_c)
        src = aggregate_usage(raw, period)

    skus = sku_dim(items)
    rows = _with_sku(src, skus)
    if start_c is not None:
        rows = rows.filter(F.col("event_start") >= start_c if mode == "contained" else F.col("event_end") > start_c)
    if end_c is not None:
        rows = rows.filter(F.col("event_end") < end_c if mode == "contained" else F.col("event_start") < end_c)

    if after is not None:
        rows = _keyset_after(rows, _find_cursor(source, skus, after, period))

    rows = rows.select(*EVENT_COLUMNS)
    if limit is not None:
        # top-k: TakeOrderedAndProject keeps k rows per task, no global sort
        return rows.orderBy(*ORDER_KEYS).limit(limit)
    return rows.orderBy(*ORDER_KEYS) if ordered else rows


def usage_export(rows: DataFrame) -> DataFrame:
    """API rows: second-resolution ``Z`` text times, SKU as ``item``."""
    return rows.select(
        "uuid",
        iso_z(F.col("event_start")).alias("event_start"),
        iso_z(F.col("event_end")).alias("event_end"),
        F.col("sku").alias("item"),
        "workspace",
        "quantity",
    )


def items_export(items: DataFrame) -> DataFrame:
    """API rows of items."""
    return items.select("uuid", "sku", "name", "unit")


def prices_export(prices: DataFrame) -> DataFrame:
    """API rows of prices (with ``sku``): second-resolution ``Z`` text times; NULL
    ``valid_until`` for an open price (a JSON writer leaves NULL fields out)."""
    return prices.select(
        "uuid",
        "sku",
        iso_z(F.col("valid_from")).alias("valid_from"),
        iso_z(F.col("valid_until")).alias("valid_until"),
        F.col("price").cast("double").alias("price"),
    )


def _first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. ``row_number() = 1`` plans a per-partition group limit before the
    shuffle, so a hot key sends one row per map task, not all of its rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def latest_events(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Q9 (bulk): the event with the latest end per key (default workspace and item);
    ties broken by the larger uuid."""
    keys = keys if keys is not None else ["workspace", "item_id"]
    if not keys:
        return events.orderBy(F.col("event_end").desc(), F.col("uuid").desc()).limit(1)
    return _first_per_key(events, keys, [F.col("event_end").desc(), F.col("uuid").desc()])


def earliest_samples(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Q10 (bulk): the first sample per key (default workspace and item); ties by smaller uuid."""
    keys = keys if keys is not None else ["workspace", "item_id"]
    if not keys:
        return samples.orderBy("sample_time", "uuid").limit(1)
    return _first_per_key(samples, keys, [F.col("sample_time").asc(), F.col("uuid").asc()])


def compact_daily(events: DataFrame) -> DataFrame:
    """A5 (extension): merge events of the same user, workspace and item within one UTC day;
    the merged row keeps the uuid of the first event (earliest start, then smallest uuid)."""
    day = floor_div(to_us(F.col("event_start")), DAY_US)
    first = F.min(F.struct(to_us(F.col("event_start")).alias("s"), F.col("uuid").alias("u")))
    return (
        events.withColumn("_day", day)
        .groupBy("user", "workspace", "item_id", "_day")
        .agg(
            first.alias("_first"),
            F.min("event_start").alias("event_start"),
            F.max("event_end").alias("event_end"),
            F.sum("quantity").alias("quantity"),
            F.count(F.lit(1)).alias("merged"),
        )
        .select(
            F.col("_first.u").alias("uuid"),
            "event_start",
            "event_end",
            "item_id",
            "user",
            "workspace",
            "quantity",
            "merged",
        )
    )


def split_midnight(events: DataFrame) -> DataFrame:
    """A6 (extension): cut events at UTC midnights; quantity is shared in proportion to seconds
    (microseconds) in each piece. A zero-length event stays whole. Piece ids are
    ``uuid`` plus ``part`` (0-based)."""
    s = to_us(F.col("event_start"))
    e = to_us(F.col("event_end"))
    d0 = floor_div(s, DAY_US)
    d1 = floor_div(e - F.lit(1), DAY_US)  # an event ending exactly at midnight has no piece after it
    exploded = events.select(
        "*",
        s.alias("_s"),
        e.alias("_e"),
        d0.alias("_d0"),
        F.explode(F.sequence(d0, F.greatest(d0, d1))).alias("_d"),
    )
    lo = F.greatest(F.col("_s"), F.col("_d") * F.lit(DAY_US))
    hi = F.least(F.col("_e"), (F.col("_d") + 1) * F.lit(DAY_US))
    dur = F.col("_e") - F.col("_s")
    share = F.when(dur == 0, F.col("quantity")).otherwise(F.col("quantity") * ((hi - lo) / dur))
    return exploded.select(
        "uuid",
        (F.col("_d") - F.col("_d0")).alias("part"),
        F.when(dur == 0, F.col("event_start")).otherwise(from_us(lo)).alias("event_start"),
        F.when(dur == 0, F.col("event_end")).otherwise(from_us(hi)).alias("event_end"),
        "item_id",
        "user",
        "workspace",
        share.alias("quantity"),
    )
