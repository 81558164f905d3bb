"""Plan shapes that matter at scale, and a hot-key fixture.

These read the physical plan (``explain`` text) of the library operators: where they
shuffle, whether a partial group limit runs before the shuffle, what is broadcast, and
which filters reach the Parquet scan.
"""

import contextlib
import datetime as dt
import io
import random
import uuid as uuidlib

from pyspark.sql import functions as F

from meterkit import schemas
from meterkit.operators import catalog, ingest, timeseries, usage
from meterkit.session import scratch_path
from meterkit.sources.tables import TableStore

from test_timeseries import _rowwise_estimates

T = dt.datetime.fromisoformat


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def samples(spark, rows):
    return spark.createDataFrame(
        [(f"s{i}", t, item, ws, float(r)) for i, (t, item, ws, r) in enumerate(rows)],
        "uuid string, sample_time timestamp_ntz, item_id string, workspace string, rate double",
    )


def test_hourly_estimates_never_shuffles_samples_by_key_alone(spark):
    rows = [(T("2025-01-01") + dt.timedelta(minutes=7 * i), "i", "w", i % 5) for i in range(50)]
    p = plan(timeseries.hourly_estimates(samples(spark, rows)))
    exchanges = [line for line in p.splitlines() if "hashpartitioning(" in line]
    # raw samples go by (key, hour); only bucket rows go by key
    assert any("b#" in line and "workspace" in line and "item_id" in line for line in exchanges), exchanges
    assert "Generate" in p


def test_hourly_estimates_shuffle_samples_twice_and_no_id_text(spark):
    """A sample is written to disk by two shuffles, with its id as bytes; parts of an hour go to the key's
    step directly and say nothing twice."""
    rows = [(T("2025-01-01") + dt.timedelta(minutes=7 * i), "i", "w", i % 5) for i in range(50)]
    blocks = plan(timeseries.hourly_estimates(samples(spark, rows))).split("\n\n")
    shuffled = [
        [c.split("#")[0] for c in line[line.index(": [") + 3 : -1].split(", ")]
        for blk in blocks if ") Exchange" in blk.splitlines()[0] for line in blk.splitlines() if line.startswith("Input")
    ]
    assert sorted(map(sorted, shuffled)) == [
        ["fr", "ft", "item_id", "more", "workspace"], ["item_id", "r", "sb", "t", "u_packed", "u_text", "workspace"],
    ]


def test_first_wins_and_latest_limit_before_shuffle(spark):
    ev = spark.createDataFrame(
        [(f"u{i % 3}", T("2025-01-01"), T("2025-01-01"), "i", None, "w", 1.0, i) for i in range(9)],
        "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, user string, "
        "workspace string, quantity double, ingest_seq long",
    )
    for df in (ingest.first_wins(ev, "uuid"), usage.latest_events(ev.drop("ingest_seq"))):
        p = plan(df)
        assert "WindowGroupLimit" in p and "Partial" in p


def test_pricing_broadcasts_timeline_and_keeps_usage_unshuffled(spark):
    prices = spark.createDataFrame(
        [("p", "i", 1, T("2025-01-01"), None, T("2025-01-01"))],
        "uuid string, item_id string, price int, valid_from timestamp_ntz, valid_until timestamp_ntz, configured_at timestamp_ntz",
    ).withColumn("price", F.col("price").cast(schemas.PRICE))
    ev = spark.createDataFrame(
        [("e", T("2025-02-01"), T("2025-02-01"), "i", "w", 2.0)],
        "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, workspace string, quantity double",
    )
    p = plan(catalog.price_usage(ev, prices))
    # the event side meets the resolved timeline in a broadcast hash join with the range as
    # its condition; no shuffle of events on item_id (few distinct values would skew it)
    joins = [blk for blk in p.split("\n\n") if blk.lstrip().startswith("(") and "Join" in blk.splitlines()[0]]
    usage_join = [blk for blk in joins if "piece_start" in blk and "event_start" in blk]
    assert usage_join and all("BroadcastHashJoin" in blk.splitlines()[0] for blk in usage_join), usage_join


def test_unpaged_usage_has_no_global_sort_and_paged_uses_top_k(spark):
    ev = spark.createDataFrame(
        [("e", T("2025-02-01"), T("2025-02-01"), "i", None, "w", 2.0)],
        "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, user string, workspace string, quantity double",
    )
    it = spark.createDataFrame([("i", "sku", "n", "u")], "uuid string, sku string, name string, unit string")
    assert "rangepartitioning" not in plan(usage.usage_query(ev, it, limit=None))
    assert "TakeOrderedAndProject" in plan(usage.usage_query(ev, it, limit=100))


def test_range_and_workspace_filters_reach_the_scan(spark):
    store = TableStore(spark, scratch_path(spark, f"test-plan-store-{uuidlib.uuid4().hex}"))
    store.create_all()
    ev = spark.createDataFrame(
        [(f"e{i}", T("2025-01-01") + dt.timedelta(hours=i), T("2025-01-01") + dt.timedelta(hours=i, minutes=5), "i", None, f"w{i % 2}", 1.0) for i in range(48)],
        schemas.BILLING_EVENT,
    )
    store.append("billing_event", ev)
    it = spark.createDataFrame([("i", "sku", "n", "u")], schemas.BILLING_ITEM)
    df = usage.usage_query(
        store.read("billing_event"), it, workspace="w1", start="2025-01-01 00:00:00", end="2025-01-03 00:00:00",
        time_aggregation="day", limit=10,
    )
    p = plan(df)
    text = " ".join(line for line in p.splitlines() if "PushedFilters" in line)
    assert "EqualTo(workspace,w1)" in text and "GreaterThanOrEqual(event_start" in text and "LessThan(event_start" in text
    # the Jan 2 bucket ends exactly at `end` and is excluded
    assert df.count() == 1


def test_hot_key_matches_rowwise_rule(spark):
    """One key holds most samples (dense, with exact hour-boundary ties); results equal the
    row-wise statement of the rule."""
    rnd = random.Random(11)
    start = T("2025-03-01")
    hot = []
    for n in range(3000):
        t = start + dt.timedelta(seconds=rnd.randint(0, 40 * 3600), microseconds=rnd.choice([0, rnd.randint(0, 999999)]))
        hot.append((t, float(rnd.randint(0, 100))))
    hot += [(start + dt.timedelta(hours=h), float(h)) for h in range(1, 40, 7)]
    hot = sorted(set(hot), key=lambda x: x[0])
    # drop exact time ties so the row-wise statement (no uuid order) is well defined
    seen, uniq = set(), []
    for t, r in hot:
        if t not in seen:
            seen.add(t)
            uniq.append((t, r))
    cold = [(start + dt.timedelta(hours=rnd.randint(0, 40), minutes=rnd.randint(0, 59)), "i", f"w{k}", 1.0) for k in range(200)]
    rows = [(t, "i", "hot", r) for t, r in uniq] + cold
    got = (
        timeseries.hourly_estimates(samples(spark, rows))
        .filter(F.col("workspace") == "hot")
        .orderBy("event_start")
        .collect()
    )
    upto = uniq[-1][0].replace(minute=0, second=0, microsecond=0)
    exp = _rowwise_estimates(uniq, uniq[0][0].replace(minute=0, second=0, microsecond=0), upto)
    assert [(r.event_start, r.event_end) for r in got] == [(a, b) for a, b, _ in exp]
    for r, (_, _, q) in zip(got, exp):
        assert abs(r.quantity - q) <= 1e-6 * max(1.0, abs(q))


def test_month_partitions_pruned(spark):
    store = TableStore(spark, scratch_path(spark, f"test-prune-{uuidlib.uuid4().hex}"))
    store.create_all()
    ev = spark.createDataFrame(
        [(f"e{m}", T(f"2025-{m:02d}-10"), T(f"2025-{m:02d}-10 01:00"), "i", None, "w", 1.0) for m in range(1, 7)],
        schemas.BILLING_EVENT,
    )
    store.append("billing_event", ev)
    df = store.read("billing_event", time_from="2025-03-01 00:00:00", time_until="2025-05-01 00:00:00")
    p = plan(df)
    assert "PartitionFilters" in p and "_month" in " ".join(l for l in p.splitlines() if "PartitionFilters" in l)
    assert sorted(r.uuid for r in df.collect()) == ["e3", "e4"]


def test_no_round_robin_in_registered_plans(spark):
    from meterkit.plans.queries import queries

    for name, query in queries().items():
        text = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" not in text, name


def test_dimension_joins_leave_facts_unshuffled(spark):
    """With the planner's own broadcasts off, stored dimensions are still broadcast by their file size."""
    store = TableStore(spark, scratch_path(spark, f"test-dims-{uuidlib.uuid4().hex}"))
    store.create_all()
    store.replace("billing_item", spark.createDataFrame([("i", "s", "", "")], schemas.BILLING_ITEM))
    store.replace("workspace_account", spark.createDataFrame([("w", "a")], schemas.WORKSPACE_ACCOUNT))
    ev = spark.createDataFrame([("e", T("2025-01-10"), T("2025-01-10 01:00"), "i", None, "w", 1.0)], schemas.BILLING_EVENT)
    store.append("billing_event", ev)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events, items, accounts = (store.read(t) for t in ("billing_event", "billing_item", "workspace_account"))
        for df in (usage.usage_query(events, items, limit=None), usage.usage_query(events, items, accounts, account="a", limit=None)):
            p = plan(df)
            assert "BroadcastHashJoin" in p and "hashpartitioning" not in p
            assert df.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _derived_items(spark):
    """Two items derived from a fact table so long that the planner takes them for large."""
    facts = spark.range(3_000_000).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("sku"))
    return facts.distinct().select(F.concat(F.lit("i-"), F.col("sku")).alias("uuid"), "sku", F.lit("").alias("name"), F.lit("").alias("unit"))


def test_items_derived_from_a_long_table_leave_facts_unshuffled(spark):
    """The few items of a fact table are broadcast by their true size: the facts are not dealt to as many tasks as there are items."""
    ev = spark.createDataFrame([(f"e{n}", T("2025-01-10"), T("2025-01-10 01:00"), f"i-s{n}", None, "w", 1.0) for n in range(3)], schemas.BILLING_EVENT)
    items = _derived_items(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        messages = ev.select("uuid", F.expr("substr(item_id, 3)").alias("sku"))
        for df, rows in (
            (usage.usage_query(ev, items, limit=None), 2),
            (usage.usage_query(ev, items, limit=5), 2),
            (usage.usage_query(ev, items, limit=5, after="e0"), 1),
            (usage.with_sku(ev, items), 2),
            (ingest.resolve_items(messages, items), 3),
        ):
            p = plan(df)
            assert "BroadcastHashJoin" in p and "hashpartitioning" not in p
            assert df.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
