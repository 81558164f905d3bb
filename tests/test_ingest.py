"""Ingest goldens (FIXTURES G9) and access filters."""

from meterkit.operators import access, ingest

MSG_SCHEMA = (
    "uuid string, event_start string, event_end string, sku string, user string, workspace string, "
    "quantity double, ingest_seq long"
)
U1 = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
U2 = "3F2504E0-4F89-11D3-9A0C-0305E82C3302"
USER = "7d444840-9dc0-11d1-b245-5ffdce74fad2"


def items_df(spark):
    return spark.createDataFrame([("item-1", "testsku", "n", "u")], "uuid string, sku string, name string, unit string")


def test_g9_ingest(spark):
    msgs = spark.createDataFrame(
        [
            (U1, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", USER, "testworkspace", 1.0, 1),
            (U1, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", USER, "testworkspace", 2.0, 2),
            (U2, "2025-01-01T01:00:00+01:00", "2025-01-01T00:05:00Z", "newsku", "", "testworkspace", 3.0, 3),
            ("abc", "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "testworkspace", 4.0, 4),
            ("3f2504e0-4f89-11d3-9a0c-0305e82c3303", "2025-01-01T02:00:00", "2025-01-01T01:00:00", "testsku", None, "w", 1.0, 5),
            ("3f2504e0-4f89-11d3-9a0c-0305e82c3304", "yesterday", "2025-01-01T01:00:00", "testsku", None, "w", 1.0, 6),
            ("3f2504e0-4f89-11d3-9a0c-0305e82c3305", "2025-01-01T00:00:00", "2025-01-01T01:00:00", "testsku", "not-a-user", "w", 1.0, 7),
        ],
        MSG_SCHEMA,
    )
    out = ingest.ingest_events(msgs, items_df(spark))
    ev = {r.uuid: r for r in out["events"].collect()}
    assert set(ev) == {U1, U2.lower()}
    assert ev[U1].quantity == 1.0 and ev[U1].user == USER and ev[U1].item_id == "item-1"
    assert ev[U2.lower()].user is None  # empty user → NULL
    assert str(ev[U2.lower()].event_start) == "2025-01-01 00:00:00"  # offset converted to UTC
    stubs = out["stubs"].collect()
    assert [(s.sku, s.name, s.unit) for s in stubs] == [("newsku", "", "")]
    assert ev[U2.lower()].item_id == stubs[0].uuid
    q = {r.ingest_seq: r.reason for r in out["quarantine"].collect()}
    assert q == {4: "bad_uuid", 5: "end_before_start", 6: "bad_time", 7: "bad_user"}


def test_first_valid_copy_wins(spark):
    msgs = spark.createDataFrame(
        [
            (U1, "bad time", "2025-01-01T00:05:00", "testsku", None, "w", 1.0, 1),
            (U1, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 2.0, 2),
            (U1, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 3.0, 3),
        ],
        MSG_SCHEMA,
    )
    ev = ingest.ingest_events(msgs, items_df(spark))["events"].collect()
    assert [r.quantity for r in ev] == [2.0]


def test_dedup_against_stored(spark):
    msgs = spark.createDataFrame(
        [(U1, "2025-01-01T00:00:00", "2025-01-01T00:05:00", "testsku", None, "w", 1.0, 1)], MSG_SCHEMA
    )
    stored = spark.createDataFrame([(U1,)], "uuid string")
    assert ingest.ingest_events(msgs, items_df(spark), stored)["events"].count() == 0


def test_workspace_map_first_wins(spark):
    a1, a2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    msgs = spark.createDataFrame(
        [("w1", a1, 1), ("w1", a2, 2), ("w2", a2, 3), ("w3", "junk", 4)], "name string, account string, ingest_seq long"
    )
    stored = spark.createDataFrame([("w2", a1)], "workspace string, account string")
    got = sorted(tuple(r) for r in ingest.workspace_map(msgs, stored).collect())
    assert got == [("w1", a1)]


def test_access_filters(spark):
    usage = spark.createDataFrame([("e1", "w1"), ("e2", "w2"), ("e3", "w3")], "uuid string, workspace string")
    ent = spark.createDataFrame(
        [
            ("alice", "workspace", "w1", "member"),
            ("alice", "workspace", "w2", "owner"),
            ("alice", "account", "acct1", "owner"),
            ("root", "global", None, "hub_admin"),
        ],
        "principal string, kind string, target string, role string",
    )
    acc = spark.createDataFrame([("w3", "acct1"), ("w1", "acct2")], "workspace string, account string")
    ids = lambda df: sorted(r.uuid for r in df.collect())
    assert ids(access.visible_usage(usage, ent, "alice")) == ["e1", "e2"]
    assert ids(access.visible_usage(usage, ent, "alice", require_owner=True)) == ["e2"]
    assert ids(access.visible_usage(usage, ent, "bob")) == []
    assert ids(access.visible_usage(usage, ent, "root", allow_hub_admin=True)) == ["e1", "e2", "e3"]
    assert ids(access.visible_usage(usage, ent, "root")) == []  # the bypass is opt-in
    assert ids(access.visible_account_usage(usage, acc, ent, "alice")) == ["e3"]
