"""Streaming ingest: micro-batch bodies against a table store, and a file-source stream.

The ``foreachBatch`` bodies are called directly with static micro-batches (the same
callables a running query gets); a file-source stream with a built-in Parquet sink runs
through Structured Streaming with ``availableNow``.
"""

import datetime as dt
import json
import os
import random
import uuid as uuidlib

import pytest
from pyspark.sql import functions as F

from meterkit import schemas
from meterkit.operators import ingest, timeseries, usage
from meterkit.session import scratch_path
from meterkit.sources.config import apply_config, config_frames, read_config
from meterkit.sources.tables import TableStore
from meterkit.streaming import ingest_stream as st

T = dt.datetime.fromisoformat


def new_store(spark):
    store = TableStore(spark, scratch_path(spark, f"test-store-{uuidlib.uuid4().hex}"))
    store.create_all()
    store.replace(
        "billing_item",
        spark.createDataFrame([("item-a", "testsku", "Test", "GB-s")], schemas.BILLING_ITEM),
    )
    return store


def sample_msgs(spark, rows, seq0=0):
    return spark.createDataFrame(
        [(u, t, sku, None, ws, float(r), seq0 + n) for n, (u, t, sku, ws, r) in enumerate(rows)], schemas.SAMPLE_MESSAGE
    )


def _u(n):
    return str(uuidlib.UUID(int=n + 1))


def test_g2_two_batches_and_replay(spark):
    store = new_store(spark)
    body = st.SampleBatch(store)
    b1 = sample_msgs(spark, [(_u(1), "2025-01-01T01:30:00", "testsku", "workspace1", 2)])
    b2 = sample_msgs(spark, [(_u(2), "2025-01-01T03:30:00", "testsku", "workspace1", 4)], seq0=10)
    body(b1, 0)
    assert store.read("billing_event").count() == 0
    body(b2, 1)
    got = sorted((r.event_start, r.quantity) for r in store.read("billing_event").collect())
    assert got == [(T("2025-01-01 01:00"), 4050.0), (T("2025-01-01 02:00"), 10800.0)]
    body(b2, 1)  # replay after a failure adds nothing
    assert store.read("billing_event").count() == 2
    assert store.read("rate_sample").count() == 2


def test_time_ordered_batches_equal_batch_estimates(spark):
    rnd = random.Random(3)
    rows = []
    for n in range(60):
        ws = f"w{rnd.randint(0, 2)}"
        t = T("2025-01-01") + dt.timedelta(seconds=rnd.randint(0, 30 * 3600), microseconds=rnd.randint(0, 999999))
        rows.append((_u(100 + n), t, ws, float(rnd.randint(0, 50))))
    rows.sort(key=lambda r: r[1])
    store = new_store(spark)
    body = st.SampleBatch(store)
    for b in range(4):
        part = rows[b * 15 : (b + 1) * 15]
        body(sample_msgs(spark, [(u, t.isoformat(), "testsku", ws, r) for u, t, ws, r in part], seq0=b * 100), b)
    streamed = {(r.workspace, r.event_start): r.quantity for r in store.read("billing_event").collect()}
    samples = spark.createDataFrame(
        [(u, t, "item-a", None, ws, r) for u, t, ws, r in rows], schemas.RATE_SAMPLE
    )
    batch = {(r.workspace, r.event_start): r.quantity for r in timeseries.hourly_estimates(samples).collect()}
    assert set(streamed) == set(batch)
    for k in batch:
        assert abs(streamed[k] - batch[k]) < 1e-6 * max(1.0, abs(batch[k])), k


def test_direct_event_moves_resume_point(spark):
    store = new_store(spark)
    samples_body, events_body = st.SampleBatch(store), st.EventBatch(store)
    samples_body(sample_msgs(spark, [(_u(10), "2025-01-01T01:30:00", "testsku", "workspace1", 2)]), 0)
    ev = spark.createDataFrame(
        [(_u(11), "2025-01-01T02:00:00", "2025-01-01T02:30:00", "testsku", None, "workspace1", 5.0, 1)], schemas.EVENT_MESSAGE
    )
    events_body(ev, 0)
    samples_body(sample_msgs(spark, [(_u(12), "2025-01-01T04:30:00", "testsku", "workspace1", 8)], seq0=5), 1)
    got = sorted(
        (r.event_start, r.event_end, r.quantity)
        for r in store.read("billing_event").filter(F.col("user").isNull() & (F.col("uuid") != _u(11))).collect()
    )
    samples = spark.createDataFrame(
        [(_u(10), T("2025-01-01 01:30"), "item-a", None, "workspace1", 2.0), (_u(12), T("2025-01-01 04:30"), "item-a", None, "workspace1", 8.0)],
        schemas.RATE_SAMPLE,
    )
    resume = spark.createDataFrame([("workspace1", "item-a", T("2025-01-01 02:30"))], "workspace string, item_id string, resume_at timestamp_ntz")
    exp = sorted((r.event_start, r.event_end, r.quantity) for r in timeseries.hourly_estimates(samples, resume=resume).collect())
    assert [g[:2] for g in got] == [(T("2025-01-01 02:30"), T("2025-01-01 03:00")), (T("2025-01-01 03:00"), T("2025-01-01 04:00"))]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, exp)) and len(got) == len(exp)


def test_rebuilt_state_equals_incremental_state(spark):
    store = new_store(spark)
    body = st.SampleBatch(store)
    rows = [(_u(300 + n), f"2025-01-02T{n % 24:02d}:{(7 * n) % 60:02d}:00", "testsku", f"w{n % 2}", float(n % 9)) for n in range(30)]
    rows.sort(key=lambda r: r[1])
    for b in range(3):
        body(sample_msgs(spark, rows[b * 10 : (b + 1) * 10], seq0=b * 100), b)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    incremental = sorted((tuple(r) for r in store.read("estimate_state").collect()), key=key)
    st.rebuild_estimate_state(store)
    rebuilt = sorted((tuple(r) for r in store.read("estimate_state").collect()), key=key)
    assert rebuilt == incremental


def test_event_batch_first_wins_and_stubs(spark):
    store = new_store(spark)
    body = st.EventBatch(store)
    u = _u(500)
    m1 = spark.createDataFrame(
        [(u, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", "", "w", 1.0, 1),
         ("abc", "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 1.0, 2)],
        schemas.EVENT_MESSAGE,
    )
    m2 = spark.createDataFrame(
        [(u, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 2.0, 3),
         (_u(501), "2025-01-01T00:00:00", "2025-01-01T00:05:00", "othersku", None, "w", 3.0, 4)],
        schemas.EVENT_MESSAGE,
    )
    body(m1, 0)
    body(m2, 1)
    body(m2, 1)
    ev = {r.uuid: r.quantity for r in store.read("billing_event").collect()}
    assert ev == {u: 1.0, _u(501): 3.0}
    assert sorted(r.sku for r in store.read("billing_item").collect()) == ["othersku", "testsku"]
    assert [r.reason for r in store.read("event_quarantine").collect()] == ["bad_uuid"]


def test_event_batch_replay_is_dropped(spark):
    store = new_store(spark)
    body = st.EventBatch(store)
    u = _u(600)
    m = spark.createDataFrame(
        [(u, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 1.0, 1)], schemas.EVENT_MESSAGE
    )
    body(m, 0)
    body(m, 1)  # the same message again (a replay) is dropped
    assert store.read("billing_event").count() == 1


def test_workspace_batch(spark):
    store = new_store(spark)
    body = st.WorkspaceBatch(store)
    a1, a2 = _u(900), _u(901)
    body(spark.createDataFrame([("w1", a1, 1), ("w1", a2, 2)], schemas.WORKSPACE_MESSAGE), 0)
    body(spark.createDataFrame([("w1", a2, 3), ("w2", a2, 4)], schemas.WORKSPACE_MESSAGE), 1)
    assert sorted(tuple(r) for r in store.read("workspace_account").collect()) == [("w1", a1), ("w2", a2)]


def test_config_load(spark):
    store = new_store(spark)
    doc = spark.createDataFrame(
        [([("testsku", None, "GB-h"), ("new", "New", "s")], [("testsku", "2025-01-01T00:00:00Z", "12.34"), ("new", "2025-01-01", "0.000000412")])],
        schemas.CONFIG,
    )
    items, prices = config_frames(doc)
    rejects = apply_config(store, items, prices, "2025-01-01 00:00:00")
    assert rejects.count() == 0
    got = sorted((r.sku, r.name, r.unit) for r in store.read("billing_item").collect())
    assert got == [("new", "New", "s"), ("testsku", "Test", "GB-h")]
    assert store.read("billing_item_price").count() == 2
    bad = spark.createDataFrame([(None, [("nosuch", "2025-01-01", "1")])], schemas.CONFIG)
    items, prices = config_frames(bad)
    assert apply_config(store, items, prices, "2025-01-02 00:00:00").count() == 1
    assert store.read("billing_item_price").count() == 2


def test_read_config_file(spark):
    root = scratch_path(spark, f"test-config-{uuidlib.uuid4().hex}")
    os.makedirs(root, exist_ok=True)
    good = os.path.join(root, "good.json")
    with open(good, "w") as f:
        json.dump({"items": [{"sku": "my-sku", "name": "my product", "unit": "GB-s"}],
                   "prices": [{"sku": "my-sku", "valid_from": "2025-01-01T00:00:00Z", "price": 12.34}]}, f, indent=2)
    items, prices = read_config(spark, good)
    assert [(r.sku, r.name, r.unit) for r in items.collect()] == [("my-sku", "my product", "GB-s")]
    assert [(r.seq, r.sku, str(r.price)) for r in prices.collect()] == [(0, "my-sku", "12.340000000000")]
    only_items = os.path.join(root, "items.json")
    with open(only_items, "w") as f:
        json.dump({"items": []}, f)
    items, prices = read_config(spark, only_items)
    assert items.count() == 0 and prices.count() == 0
    assert read_config(spark, os.path.join(root, "missing.json")) is None
    bad = os.path.join(root, "bad.json")
    with open(bad, "w") as f:
        json.dump([{"items": []}], f)
    with pytest.raises(ValueError):
        read_config(spark, bad)


def test_file_stream_validates_like_batch(spark):
    root = scratch_path(spark, f"test-stream-{uuidlib.uuid4().hex}")
    src = os.path.join(root, "in")
    os.makedirs(src, exist_ok=True)
    msgs = [
        {"uuid": _u(n), "event_start": f"2025-01-01T0{n % 10}:00:00", "event_end": f"2025-01-01T0{n % 10}:30:00",
         "sku": "testsku", "user": None, "workspace": f"w{n % 3}", "quantity": float(n), "ingest_seq": n}
        for n in range(20)
    ] + [{"uuid": "bad", "event_start": "x", "event_end": "y", "sku": "s", "user": None, "workspace": "w", "quantity": 1.0, "ingest_seq": 99}]
    for part in range(3):
        with open(os.path.join(src, f"part-{part}.json"), "w") as f:
            for m in msgs[part::3]:
                f.write(json.dumps(m) + "\n")
    stream = st.read_message_stream(spark, src, schemas.EVENT_MESSAGE)
    out = os.path.join(root, "valid")
    q = (
        st.validated_stream(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", os.path.join(root, "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    streamed = sorted(r.uuid for r in spark.read.parquet(out).collect())
    batch = spark.read.schema(schemas.EVENT_MESSAGE).json(src)
    expected = sorted(r.uuid for r in ingest.valid(ingest.parse_event_messages(batch)).collect())
    assert streamed == expected and len(expected) == 20


def test_unnumbered_messages_are_ordered_by_block(spark):
    """A file of three splits; the first copy stands in the second, the re-sent one in the third."""
    root = scratch_path(spark, f"test-blocks-{uuidlib.uuid4().hex}")
    src, split = os.path.join(root, "in"), 700 << 10
    os.makedirs(src)
    line = lambda n, q: json.dumps({"uuid": _u(n), "event_start": "2025-01-01T00:00:00", "event_end": "2025-01-01T00:30:00", "sku": "s", "workspace": "w", "quantity": q}).ljust(1023) + "\n"
    with open(os.path.join(src, "a.json"), "w") as f:
        f.writelines(line(1 if n in (1000, 1800) else n + 10, float(n)) for n in range(2000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        out = os.path.join(root, "out")
        stream = st.read_message_stream(spark, src, schemas.EVENT_MESSAGE)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    messages = spark.read.parquet(out)
    assert messages.count() == 2000 and messages.filter(F.col("ingest_seq").isNull()).count() == 0
    items = spark.createDataFrame([], schemas.BILLING_ITEM)
    events = ingest.ingest_events(messages, items)["events"]
    assert events.columns == ["uuid", "event_start", "event_end", "item_id", "user", "workspace", "quantity"]
    assert events.count() == 1999 and [r.quantity for r in events.filter(F.col("uuid") == _u(1)).collect()] == [1000.0]


def test_broker_messages_are_ordered_by_offset(spark):
    """Offsets of one millisecond across a multiple of 16,384, where 20 bits start anew."""
    raw = spark.createDataFrame([("w", 0, 16_383), ("w", 0, 16_384)], "workspace string, partition int, offset long")
    raw = raw.withColumn("timestamp", F.timestamp_millis(F.lit(1_700_000_000_000)))
    kept = ingest.first_wins(raw.select("workspace", "offset", *st._kafka_position()), "workspace").collect()
    assert [r.offset for r in kept] == [16_383]


def test_dedupe_within_watermark_stream(spark):
    root = scratch_path(spark, f"test-dedupe-{uuidlib.uuid4().hex}")
    src = os.path.join(root, "in")
    os.makedirs(src, exist_ok=True)
    with open(os.path.join(src, "a.json"), "w") as f:
        for n in (1, 2, 2, 3, 3, 3):
            f.write(json.dumps({"uuid": _u(n), "ts": "2025-01-01T00:00:00"}) + "\n")
    stream = spark.readStream.schema("uuid string, ts timestamp").json(src)
    q = (
        st.dedupe_within_watermark(stream, "ts")
        .writeStream.format("parquet")
        .option("path", os.path.join(root, "out"))
        .option("checkpointLocation", os.path.join(root, "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(root, "out")).select(F.countDistinct("uuid")).first()[0] == 3
    assert spark.read.parquet(os.path.join(root, "out")).count() == 3


def estimates(store, ids):
    return sorted((r.event_start, r.quantity) for r in store.read("billing_event").collect() if r.uuid not in ids)


def test_resent_sample_does_not_change_usage(spark):
    """A copy of a stored sample with another time and rate closes hours but feeds no integral."""
    store = new_store(spark)
    body = st.SampleBatch(store)
    body(sample_msgs(spark, [(_u(1), "2025-01-01T01:30:00", "testsku", "w", 2)]), 0)
    body(sample_msgs(spark, [(_u(2), "2025-01-01T02:30:00", "testsku", "w", 2), (_u(3), "2025-01-01T04:30:00", "testsku", "w", 4)], seq0=5), 1)
    body(sample_msgs(spark, [(_u(1), "2025-01-01T05:30:00", "testsku", "w", 1000)], seq0=9), 2)
    assert store.read("rate_sample").count() == 3
    got = dict(estimates(store, ()))
    assert abs(got[T("2025-01-01 04:00")] - 6750) < 1e-6
    before = estimates(store, ())
    body(sample_msgs(spark, [(_u(1), "2025-01-01T05:30:00", "testsku", "w", 1000)], seq0=9), 2)  # a replay
    assert estimates(store, ()) == before


def test_resent_event_does_not_move_the_resume_point(spark):
    store = new_store(spark)
    body = st.EventBatch(store)
    row = lambda end, seq: spark.createDataFrame([(_u(1), "2025-01-01T00:00:00", end, "testsku", None, "w", 1.0, seq)], schemas.EVENT_MESSAGE)
    body(row("2025-01-01T01:00:00", 1), 0)
    body(row("2025-01-01T09:00:00", 2), 1)
    assert [r.resume_at for r in store.read("estimate_state").collect()] == [T("2025-01-01 01:00")]


def test_quarantine_is_replay_safe(spark):
    store = new_store(spark)
    body = st.EventBatch(store)
    bad = spark.createDataFrame(
        [(None, "2025-01-01T00:00:00", "2025-01-01T01:00:00", "testsku", None, "w", 1.0, 1), ("x", "2025-01-01T00:00:00", "2025-01-01T01:00:00", "testsku", None, "w", 1.0, None)],
        schemas.EVENT_MESSAGE,
    )
    body(bad, 0)
    body(bad, 0)
    assert store.read("event_quarantine").count() == 2


def test_two_streams_on_one_store(spark):
    store = new_store(spark)
    events, samples = st.EventBatch(store), st.SampleBatch(store)
    for n in range(3):
        events(spark.createDataFrame([(_u(700 + n), "2025-01-01T00:00:00", "2025-01-01T00:05:00", f"ev{n}", None, "w", 1.0, n)], schemas.EVENT_MESSAGE), n)
        samples(sample_msgs(spark, [(_u(800 + n), f"2025-01-01T0{n}:30:00", f"sa{n}", "w", 2)], seq0=n), n)
    assert {f"ev{n}" for n in range(3)} | {f"sa{n}" for n in range(3)} <= {r.sku for r in store.read("billing_item").collect()}
    assert len({(r.workspace, r.item_id) for r in store.read("estimate_state").collect()}) == 6


def test_table_versions(spark):
    store = new_store(spark)
    first = store.snapshot()
    for n in range(5):
        store.replace("billing_item", spark.createDataFrame([(f"i{n}", f"s{n}", "", "")], schemas.BILLING_ITEM))
    assert [r.sku for r in store.read("billing_item").collect()] == ["s4"]
    assert [r.sku for r in first.read("billing_item").collect()] == ["testsku"]  # a pinned snapshot
    # a write that broke off before its commit is never read, and another reader's commit takes the next number
    torn = store.begin()
    torn.replace("billing_item", spark.createDataFrame([("x", "torn", "", "")], schemas.BILLING_ITEM))
    assert [r.sku for r in torn.read("billing_item").collect()] == ["torn"]
    assert [r.sku for r in store.read("billing_item").collect()] == ["s4"]
    top = store.versions()[-1]
    store.replace("billing_item", spark.createDataFrame([("y", "s9", "", "")], schemas.BILLING_ITEM))
    assert [r.sku for r in store.read("billing_item").collect()] == ["s9"] and store.versions()[-1] == top + 1
    assert not store.log.put(top + 1, {}) and [r.sku for r in store.read("billing_item").collect()] == ["s9"]
    torn.close()
    store.vacuum()
    assert len(store.versions()) == 3 and [r.sku for r in store.read("billing_item").collect()] == ["s9"]


def test_broken_config_is_an_error(spark, tmp_path):
    for n, text in enumerate(['{"items": [{"sku": "a"', '{"items": 5 oops}', "[1]"]):
        p = tmp_path / f"c{n}.json"
        p.write_text(text)
        with pytest.raises(ValueError):
            read_config(spark, str(p))


def test_store_usage_prunes_months(spark):
    store = new_store(spark)
    rows = [(_u(n), T(f"2025-0{1 + n % 4}-10 00:00"), T(f"2025-0{1 + n % 4}-10 01:00"), "item-a", None, "w", 1.0) for n in range(8)]
    store.append("billing_event", spark.createDataFrame(rows, schemas.BILLING_EVENT))
    items = store.read("billing_item")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for kw in ({}, {"time_aggregation": "day"}, {"mode": "overlap"}):
        df = usage.usage_query(store, items, start="2025-02-01 00:00:00", end="2025-03-01 00:00:00", limit=None, **kw)
        filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
        assert "_month" in filters, kw
        assert df.count() == (1 if kw.get("time_aggregation") else 2)
