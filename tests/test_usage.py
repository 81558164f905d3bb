"""Usage query goldens (FIXTURES G3–G6, Q8) and the extensions A5/A6."""

import datetime as dt

import pytest

from meterkit.operators import usage

T = dt.datetime.fromisoformat
ITEMS = [("i1", "sku1", "n1", "u"), ("i2", "sku2", "n2", "u")]


def items_df(spark):
    return spark.createDataFrame(ITEMS, "uuid string, sku string, name string, unit string")


def events_df(spark, rows):
    return spark.createDataFrame(
        [(u, T(s), T(e), item, user, ws, float(q)) for u, s, e, item, user, ws, q in rows],
        "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, user string, "
        "workspace string, quantity double",
    )


G3 = [
    ("e1", "2025-01-01 00:00", "2025-01-01 01:00", "i1", None, "workspace1", 0.01),
    ("e2", "2025-01-01 02:00", "2025-01-01 03:00", "i1", None, "workspace1", 0.1),
    ("e3", "2025-01-01 23:00", "2025-01-02 00:00", "i1", None, "workspace1", 1),
    ("e4", "2025-01-02 02:00", "2025-01-02 03:00", "i1", None, "workspace1", 0.2),
    ("e5", "2025-02-02 00:00", "2025-02-03 00:00", "i1", None, "workspace1", 0.4),
    ("e6", "2025-01-01 02:00", "2025-01-01 03:00", "i2", None, "workspace1", 0.2),
    ("e7", "2025-01-01 02:00", "2025-01-01 03:00", "i2", None, "workspace2", 0.5),
]


def q(spark, rows=G3, **kw):
    return usage.usage_query(events_df(spark, rows), items_df(spark), **kw)


def test_g3_daily_monthly_raw(spark):
    day = [(r.event_start, r.sku, round(r.quantity, 9)) for r in q(spark, workspace="workspace1", time_aggregation="day").collect()]
    assert day == [
        (T("2025-01-01"), "sku1", 1.11),
        (T("2025-01-01"), "sku2", 0.2),
        (T("2025-01-02"), "sku1", 0.2),
        (T("2025-02-02"), "sku1", 0.4),
    ]
    month = [(r.event_start, r.event_end, r.sku, round(r.quantity, 9)) for r in q(spark, workspace="workspace1", time_aggregation="month").collect()]
    assert month == [
        (T("2025-01-01"), T("2025-02-01"), "sku1", 1.31),
        (T("2025-01-01"), T("2025-02-01"), "sku2", 0.2),
        (T("2025-02-01"), T("2025-03-01"), "sku1", 0.4),
    ]
    agg = q(spark, workspace="workspace1", time_aggregation="day").collect()
    assert all(r.user is None for r in agg)
    assert agg[0].uuid == "e3"  # the largest uuid of the group
    assert q(spark, workspace="workspace1").count() == 6


@pytest.mark.parametrize("size,pages", [(100, [4]), (3, [3, 1]), (2, [2, 2])])
def test_g3_paging_aggregated(spark, size, pages):
    got, after = [], None
    while True:
        page = q(spark, workspace="workspace1", time_aggregation="day", limit=size, after=after).collect()
        if not page:
            break
        got.append(len(page))
        after = page[-1].uuid
    assert got == pages


def test_g4_keyset_paging_visits_every_event_once(spark):
    rows = [(f"p{i}", f"2025-01-01 0{i % 3}:00", f"2025-01-01 0{i % 3}:05", "i1", None, "w", 1) for i in range(5)]
    full = [r.uuid for r in q(spark, rows, limit=None, ordered=True).collect()]
    seen, sizes, after = [], [], None
    while True:
        page = q(spark, rows, limit=2, after=after).collect()
        if not page:
            break
        sizes.append(len(page))
        seen += [r.uuid for r in page]
        after = page[-1].uuid
    assert sizes == [2, 2, 1] and seen == full and len(set(seen)) == 5


def test_g5_range_contains(spark):
    rows = [(f"r{h}", f"2025-01-01 {h:02d}:10", f"2025-01-01 {h:02d}:15", "i1", None, "workspace1", 1) for h in (6, 7, 8, 9)]
    got = [r.event_start for r in q(spark, rows, start="2025-01-01 07:05:00", end="2025-01-01 09:05:00").collect()]
    assert got == [T("2025-01-01 07:10"), T("2025-01-01 08:10")]
    overlap = q(spark, rows, start="2025-01-01 07:12:00", end="2025-01-01 09:12:00", mode="overlap").collect()
    assert [r.uuid for r in overlap] == ["r7", "r8", "r9"]


def test_range_end_exclusive_on_bucket_end(spark):
    # a daily bucket ending exactly at `end` is excluded
    got = q(spark, workspace="workspace1", time_aggregation="day", end="2025-01-02 00:00:00").collect()
    assert got == []
    got = q(spark, workspace="workspace1", time_aggregation="day", end="2025-01-02 00:00:01").collect()
    assert len(got) == 2


def test_g6_account(spark):
    rows = [
        ("a1", "2025-01-01 00:00", "2025-01-01 00:05", "i1", None, "workspace1", 1),
        ("a2", "2025-01-01 01:00", "2025-01-01 01:05", "i1", None, "workspace1", 1),
        ("a3", "2025-01-01 02:00", "2025-01-01 02:05", "i1", None, "workspace2", 1),
        ("a4", "2025-01-01 03:00", "2025-01-01 03:05", "i1", None, "workspace3", 1),
    ]
    acc = spark.createDataFrame(
        [("workspace1", "account1"), ("workspace2", "account1"), ("workspace3", "account2")], "workspace string, account string"
    )
    ev, it = events_df(spark, rows), items_df(spark)
    assert usage.usage_query(ev, it, acc, account="account1").count() == 3
    assert usage.usage_query(ev, it, acc, account="account2").count() == 1


def test_q8_unknown_cursor(spark):
    with pytest.raises(usage.CursorNotFound):
        q(spark, after="nope")


def test_unknown_aggregation_rejected(spark):
    with pytest.raises(ValueError):
        q(spark, time_aggregation="week")


def test_latest_and_earliest(spark):
    got = {(r.workspace, r.item_id): r.uuid for r in usage.latest_events(events_df(spark, G3)).collect()}
    assert got == {("workspace1", "i1"): "e5", ("workspace1", "i2"): "e6", ("workspace2", "i2"): "e7"}


def test_compact_and_split(spark):
    c = usage.compact_daily(events_df(spark, G3)).filter("workspace = 'workspace1' AND item_id = 'i1'").orderBy("event_start").collect()
    assert [(r.uuid, r.merged, round(r.quantity, 9)) for r in c] == [("e1", 3, 1.11), ("e4", 1, 0.2), ("e5", 1, 0.4)]
    rows = [("m", "2025-01-01 23:00", "2025-01-02 01:00", "i1", None, "w", 2.0), ("z", "2025-01-01 05:00", "2025-01-01 05:00", "i1", None, "w", 3.0)]
    s = usage.split_midnight(events_df(spark, rows)).orderBy("uuid", "part").collect()
    assert [(r.uuid, r.part, r.event_start, r.event_end, r.quantity) for r in s] == [
        ("m", 0, T("2025-01-01 23:00"), T("2025-01-02 00:00"), 1.0),
        ("m", 1, T("2025-01-02 00:00"), T("2025-01-02 01:00"), 1.0),
        ("z", 0, T("2025-01-01 05:00"), T("2025-01-01 05:00"), 3.0),
    ]


def test_export_format(spark):
    rows = [("x", "2025-01-01 00:00:00.75", "2025-01-01 01:00", "i1", None, "w", 1)]
    r = usage.usage_export(q(spark, rows)).collect()[0]
    assert (r.event_start, r.event_end, r.item) == ("2025-01-01T00:00:00Z", "2025-01-01T01:00:00Z", "sku1")
