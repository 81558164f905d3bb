"""Table store: snapshots, conflicts, the uuid ledger, state deltas, compaction, dead letters."""

import datetime as dt
import random
import uuid as uuidlib

import pytest
from pyspark.sql import functions as F

from meterkit import schemas
from meterkit.operators import usage
from meterkit.session import scratch_path
from meterkit.sources.config import apply_config, config_frames
from meterkit.sources.tables import CommitConflict, TableStore
from meterkit.streaming import ingest_stream as st

T = dt.datetime.fromisoformat


def _u(n):
    return str(uuidlib.UUID(int=n + 1, version=4))


def new_root(spark):
    root = scratch_path(spark, f"test-tables-{uuidlib.uuid4().hex}")
    store = TableStore(spark, root)
    store.create_all()
    store.replace("billing_item", spark.createDataFrame([("item-a", "testsku", "Test", "GB-s")], schemas.BILLING_ITEM))
    return root, store


def item(spark, n):
    return spark.createDataFrame([(f"i{n}", f"s{n}", "", "")], schemas.BILLING_ITEM)


def event(n, month=1, workspace="w", quantity=1.0):
    return (_u(n), T(f"2025-{month:02d}-10 00:00"), T(f"2025-{month:02d}-10 01:00"), "item-a", None, workspace, quantity)


def event_message(spark, *rows):
    return spark.createDataFrame([(u, "2025-01-01T00:00:00", "2025-01-01T00:05:00", sku, None, "w", q, seq) for u, sku, q, seq in rows], schemas.EVENT_MESSAGE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_second_of_two_writers_is_told(spark):
    """Two readers of one version replace a dimension: the second one does not lose the first one's row."""
    root, _ = new_root(spark)
    one, two = TableStore(spark, root), TableStore(spark, root)
    a, b = one.read("billing_item"), two.read("billing_item")
    one.replace("billing_item", a.unionByName(item(spark, 1)))
    with pytest.raises(CommitConflict):
        two.replace("billing_item", b.unionByName(item(spark, 2)))
    assert sorted(r.sku for r in one.read("billing_item").collect()) == ["s1", "testsku"]


def test_a_conflicting_body_runs_again(spark):
    """Both writers' rows are kept: the body that finds its table changed starts from the new one."""
    root, store = new_root(spark)
    tries = []

    def add(tx):
        tries.append(tx.version)
        items = tx.read("billing_item")
        if len(tries) == 1:
            TableStore(spark, root).run(lambda other: other.replace("billing_item", other.read("billing_item").unionByName(item(spark, 1))))
        tx.replace("billing_item", items.unionByName(item(spark, 2)))

    store.run(add)
    assert len(tries) == 2 and tries[1] > tries[0]
    assert sorted(r.sku for r in store.read("billing_item").collect()) == ["s1", "s2", "testsku"]
    with pytest.raises(CommitConflict):
        store.run(lambda tx: (tx.read("billing_item"), TableStore(spark, root).replace("billing_item", item(spark, 9)), tx.replace("billing_item", item(spark, 8))), attempts=2)


def test_two_streams_in_one_moment(spark):
    """An event batch commits between a sample batch's read and its commit: both keep stub items, state and rows."""
    root, store = new_root(spark)

    class Interrupted(st.SampleBatch):
        done = False

        def apply(self, tx, batch):
            super().apply(tx, batch)
            if not self.done:
                self.done = True
                st.EventBatch(TableStore(spark, root))(event_message(spark, (_u(1), "evsku", 1.0, 1)), 0)

    sample = spark.createDataFrame([(_u(2), "2025-01-01T01:30:00", "sasku", None, "w", 2.0, 1)], schemas.SAMPLE_MESSAGE)
    Interrupted(store)(sample, 0)
    assert {r.sku for r in store.read("billing_item").collect()} == {"testsku", "evsku", "sasku"}
    assert store.read("rate_sample").count() == 1 and store.read("billing_event").count() == 1
    assert len({(r.workspace, r.item_id) for r in store.read("estimate_state").collect()}) == 2


def test_same_uuid_from_two_writers_is_billed_once(spark):
    root, store = new_root(spark)

    class Interrupted(st.EventBatch):
        done = False

        def apply(self, tx, batch):
            super().apply(tx, batch)
            if not self.done:
                self.done = True
                st.EventBatch(TableStore(spark, root))(event_message(spark, (_u(1), "testsku", 1.0, 1)), 0)

    Interrupted(store)(event_message(spark, (_u(1), "testsku", 5.0, 2), (_u(2), "testsku", 7.0, 3)), 0)
    assert {r.uuid: r.quantity for r in store.read("billing_event").collect()} == {_u(1): 1.0, _u(2): 7.0}


def test_nothing_is_seen_of_a_body_that_breaks_off(spark):
    """After a crash at any step the tables are those of the last commit, and the batch can be sent again."""
    root, store = new_root(spark)
    batch = event_message(spark, (_u(1), "newsku", 1.0, 1), ("bad", "newsku", 1.0, 2))
    before = store.versions()

    for step in ("append", "replace", "write_state", "commit"):
        class Broken(st.EventBatch):
            def apply(self, tx, b, step=step):
                def stop(*_args, **_kw):
                    raise OSError("gone")

                setattr(tx, step, stop)
                super().apply(tx, b)

        with pytest.raises(OSError):
            Broken(store)(batch, 0)
        assert store.versions() == before and store.read("billing_event").count() == 0 and store.read("event_quarantine").count() == 0
    st.EventBatch(store)(batch, 0)
    assert store.read("billing_event").count() == 1 and store.read("event_quarantine").count() == 1
    assert store.versions() == [*before, before[-1] + 1]  # one commit
    fs, p, _ = store._fs(f"{root}/_staging")
    assert not fs.exists(p) or len(fs.listStatus(p)) == 0


def test_configuration_switches_both_tables_at_once(spark):
    _, store = new_root(spark)
    doc = spark.createDataFrame([([("testsku", "Renamed", None)], [("testsku", "2025-01-01", "2.5")])], schemas.CONFIG)
    before = store.versions()[-1]
    assert apply_config(store, *config_frames(doc), "2025-01-01 00:00:00").count() == 0
    now = store.snapshot()
    assert now.version == before + 1
    assert [r.name for r in now.read("billing_item").collect()] == ["Renamed"] and now.read("billing_item_price").count() == 1
    old = store.snapshot(before)
    assert [r.name for r in old.read("billing_item").collect()] == ["Test"] and old.read("billing_item_price").count() == 0


def test_pages_of_one_snapshot_agree(spark):
    _, store = new_root(spark)
    store.append("billing_event", spark.createDataFrame([event(n) for n in range(6)], schemas.BILLING_EVENT))
    now, items = store.snapshot(), store.read("billing_item")
    first = usage.usage_query(now, items, limit=3).collect()
    store.append("billing_event", spark.createDataFrame([event(n) for n in range(20, 26)], schemas.BILLING_EVENT))
    by_uuid = usage.usage_query(now, items, limit=10, after=first[-1].uuid).collect()
    by_row = usage.usage_query(now, items, limit=10, after=first[-1]).collect()
    assert by_uuid == by_row and {r.uuid for r in [*first, *by_uuid]} == {_u(n) for n in range(6)}


def test_ledger_reads_the_batch_s_buckets_and_months(spark):
    _, store = new_root(spark)
    for part in range(3):
        store.append("billing_event", spark.createDataFrame([event(n, 1 + n % 6) for n in range(100 * part, 100 * part + 100)], schemas.BILLING_EVENT))
    now = store.snapshot()
    uuids = spark.createDataFrame([(_u(7),), (_u(150),), (_u(5000),)], "uuid string")
    buckets = {r[0] for r in uuids.select(F.pmod(F.xxhash64("uuid"), F.lit(store.ledger_buckets)).cast("int")).collect()}
    hits = now.ledger_hits("billing_event", uuids)
    assert {tuple(r) for r in hits.collect()} == {(_u(7), "2025-02"), (_u(150), "2025-01")}
    filters = plan(hits).split("PartitionFilters: [")[1].split("]")[0]
    assert "_bucket" in filters and all(str(b) in filters for b in buckets) and len(buckets) < store.ledger_buckets
    files = {f.split("_bucket=")[1].split("/")[0] for f in now._ledger("billing_event").filter(F.col("_bucket").isin(sorted(buckets))).inputFiles()}
    assert len(files) >= len(buckets)
    found = now.known("billing_event", uuids)
    assert {r.uuid for r in found.collect()} == {_u(7), _u(150)}
    month = next(x for x in plan(found).split("PartitionFilters: [")[1:] if "_month" in x.split("]")[0]).split("]")[0]
    assert "2025-02" in month and "2025-01" in month and "2025-03" not in month
    assert now.known("billing_event", spark.createDataFrame([(_u(9999),)], "uuid string")).count() == 0


def test_cursor_by_ledger_reads_one_month(spark):
    _, store = new_root(spark)
    rows = [event(n, 1 + n % 5, quantity=float(n)) for n in range(40)]
    store.append("billing_event", spark.createDataFrame(rows, schemas.BILLING_EVENT))
    items = store.read("billing_item")
    flat = spark.createDataFrame(rows, schemas.BILLING_EVENT)
    month = plan(store.snapshot().find("billing_event", _u(13))).split("PartitionFilters: [")[1].split("]")[0]
    assert "2025-04" in month and "2025-03" not in month
    for kw in ({}, {"workspace": "w"}, {"time_aggregation": "day"}, {"time_aggregation": "month"}):
        page = usage.usage_query(flat, items, limit=4, **kw).collect()
        want = usage.usage_query(flat, items, limit=5, after=page[-1].uuid, **kw).collect()
        assert usage.usage_query(store, items, limit=5, after=page[-1].uuid, **kw).collect() == want
    for kw in ({}, {"time_aggregation": "day"}):
        with pytest.raises(usage.CursorNotFound):
            usage.usage_query(store, items, after=_u(999), **kw)


def test_state_deltas_and_folding(spark):
    _, store = new_root(spark)
    rng, want = random.Random(1), {}
    state = lambda k, t: (f"w{k}", "item-a", T(f"2025-01-01 {t % 24:02d}:00"), None, None, None)
    for n in range(30):
        keys = rng.sample(range(12), 2)
        want |= {f"w{k}": T(f"2025-01-01 {n % 24:02d}:00") for k in keys}
        rows = spark.createDataFrame([state(k, n) for k in keys], schemas.ESTIMATE_STATE)
        store.run(lambda tx: tx.write_state("estimate_state", rows))
    assert {r.workspace: r.resume_at for r in store.read("estimate_state").collect()} == want
    now = store.snapshot()
    per_bucket = [f.rpartition("=")[2] for f in now._folders("estimate_state")]
    assert max(per_bucket.count(b) for b in per_bucket) <= 8  # folded
    one = spark.createDataFrame([("w3", "item-a")], "workspace string, item_id string")
    some = now.state_of("estimate_state", one)
    assert [r.resume_at for r in some.collect()] == [want["w3"]]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in some.inputFiles()}) == 1  # one bucket is read
    store.run(lambda tx: tx.write_state("estimate_state", spark.createDataFrame([state(3, 5)], schemas.ESTIMATE_STATE)))
    new = set(store.snapshot()._folders("estimate_state")) - set(now._folders("estimate_state"))
    assert len(new) == 1  # what is written follows the batch


def test_compaction_keeps_rows_and_lets_appends_pass(spark):
    root, store = new_root(spark)
    for part in range(4):
        store.append("billing_event", spark.createDataFrame([event(10 * part + n, 1 + n % 2) for n in range(5)], schemas.BILLING_EVENT))
    tx = store.begin()
    folders = tx.tables["billing_event"]["folders"]
    assert len(folders) == 4
    store.compact("billing_event")
    tx.close()
    now = store.snapshot()
    assert len(now._folders("billing_event")) == 1 and len(now._folders("billing_event_keys")) == 1
    assert {r.uuid for r in now.read("billing_event").collect()} == {_u(10 * p + n) for p in range(4) for n in range(5)}
    assert now.known("billing_event", spark.createDataFrame([(_u(23),)], "uuid string").unionByName(spark.createDataFrame([(_u(777),)], "uuid string"))).count() == 1
    store.append("billing_event", spark.createDataFrame([event(500)], schemas.BILLING_EVENT))
    store.vacuum(keep=1)
    assert store.read("billing_event").count() == 21
    fs, p, path = store._fs(f"{root}/billing_event")
    assert len(fs.listStatus(p)) == 2


def test_buckets_are_those_of_the_first_commit(spark):
    root = scratch_path(spark, f"test-tables-{uuidlib.uuid4().hex}")
    TableStore(spark, root, ledger_buckets=5, state_buckets=3).create_all()
    other = TableStore(spark, root)
    assert (other.ledger_buckets, other.state_buckets) == (5, 3)


def test_dead_letters_are_kept_and_repaired(spark):
    _, store = new_root(spark)
    body = st.EventBatch(store)
    # two different bad messages without id and position, and one that is sent twice
    bad = spark.createDataFrame(
        [(None, "2025-01-01T00:00:00", "2025-01-01T01:00:00", "testsku", None, "w", q, None) for q in (1.0, 2.0)]
        + [(_u(5), "nonsense", "2025-01-01T01:00:00", "testsku", None, "w", 3.0, 7)],
        schemas.EVENT_MESSAGE,
    )
    body(bad, 0)
    body(bad, 0)
    rows = store.read("event_quarantine").collect()
    assert sorted(r.reason for r in rows) == ["bad_time", "bad_uuid", "bad_uuid"] and len({r.digest for r in rows}) == 3
    letters = st.dead_letters(store, "event_quarantine", schemas.EVENT_MESSAGE)
    assert sorted(r.quantity for r in letters.collect()) == [1.0, 2.0, 3.0]
    fixed = letters.filter("reason = 'bad_time'").withColumn("event_start", F.lit("2025-01-01T00:00:00")).select(*schemas.EVENT_MESSAGE.fieldNames())
    body(fixed, 1)
    body(fixed, 2)
    assert [(r.uuid, r.quantity) for r in store.read("billing_event").collect()] == [(_u(5), 3.0)]


def test_bad_workspace_messages_are_quarantined(spark):
    _, store = new_root(spark)
    body = st.WorkspaceBatch(store)
    batch = spark.createDataFrame([("w1", _u(1), 1), ("", _u(2), 2), ("w3", "no id", 3)], schemas.WORKSPACE_MESSAGE)
    body(batch, 0)
    body(batch, 0)
    assert [r.workspace for r in store.read("workspace_account").collect()] == ["w1"]
    assert sorted((r.name, r.reason) for r in store.read("workspace_quarantine").collect()) == [("", "missing_field"), ("w3", "bad_account")]


def test_broker_message_that_is_no_json_keeps_its_text(spark):
    raw = spark.createDataFrame([(bytearray(b"{broken"), 0, 1)], "value binary, partition int, offset long").withColumn("timestamp", F.timestamp_millis(F.lit(1_700_000_000_000)))
    _, store = new_root(spark)
    st.EventBatch(store)(st.broker_messages(raw, schemas.EVENT_MESSAGE), 0)
    assert [(r.reason, r.payload) for r in store.read("event_quarantine").collect()] == [("bad_uuid", "{broken")]


def test_ties_of_unnumbered_messages_go_by_content(spark):
    from meterkit.operators import ingest

    at = F.struct(F.lit(1).alias("seq"), F.lit("f").alias("path"), F.lit(0).alias("block"))
    rows = spark.createDataFrame([("w", f"a{n}", None) for n in range(50)], "workspace string, account string, ingest_seq long").withColumn("ingest_at", at)
    kept = {ingest.first_wins(rows.repartition(n), "workspace").first().account for n in (1, 3, 7)}
    assert len(kept) == 1


def test_overlap_reads_the_partitions_that_reach_into_the_range(spark):
    _, store = new_root(spark)
    rng = random.Random(6)
    rows = []
    for n in range(60):
        start = T("2024-01-01") + dt.timedelta(days=rng.randrange(500), hours=rng.randrange(24))
        length = dt.timedelta(days=200) if n % 20 == 0 else dt.timedelta(hours=rng.randrange(0, 60))
        rows.append((_u(n), start, start + length, "item-a", None, "w", 1.0))
    flat = spark.createDataFrame(rows, schemas.BILLING_EVENT)
    store.append("billing_event", flat)
    items, lo, hi = store.read("billing_item"), "2025-02-03 05:00:00", "2025-02-20 00:00:00"
    for kw in ({}, {"time_aggregation": "day"}, {"time_aggregation": "month"}):
        got = usage.usage_query(store, items, start=lo, end=hi, mode="overlap", limit=None, **kw)
        want = usage.usage_query(flat, items, start=lo, end=hi, mode="overlap", limit=None, **kw)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 0
        filters = plan(got).split("PartitionFilters: [")[1].split("]")[0]
        assert ("_until" if not kw else "_month") in filters
    read = store.snapshot().read("billing_event", time_until=hi, ends_after=lo)
    months = {f.split("_month=")[1][:7] for f in read.inputFiles()}
    older = {f.split("_month=")[1][:7] for f in store.read("billing_event").inputFiles()}
    assert len(months) <= len(older)
    assert plan(read).count("_until") > 0 and {r.uuid for r in read.collect()} == {r[0] for r in rows if r[1] < T(hi) and r[2] > T(lo)}


def test_price_list_of_any_past_moment(spark):
    """Random loads with overwrites and closings against the lists that a replay had after each load."""
    from meterkit.operators import catalog

    _, store = new_root(spark)
    rng, lists = random.Random(8), []
    for load in range(4):
        prices = [("testsku", f"2025-01-{rng.randrange(1, 28):02d}", str(rng.randrange(1, 9))) for _ in range(2)]
        at = f"2025-0{load + 1}-01 00:00:00"
        doc = spark.createDataFrame([(None, sorted(prices, key=lambda p: p[1]))], schemas.CONFIG)
        apply_config(store, *config_frames(doc), at)
        lists.append((at, sorted(map(tuple, store.read("billing_item_price").collect()), key=str)))
    assert len({str(x) for _, x in lists}) > 1
    history = store.read("price_history")
    for at, want in lists:
        for moment in (at, at.replace("01 00:00:00", "15 00:00:00")):
            got = catalog.prices_known(history, moment)
            assert got.columns == schemas.BILLING_ITEM_PRICE.fieldNames()
            assert sorted(map(tuple, got.collect()), key=str) == want
    assert catalog.prices_known(history, "2024-12-31 00:00:00").count() == 0
