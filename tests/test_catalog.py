"""Items and prices (FIXTURES G7, G8, G10) plus price rejects, pricing and the set-form
price upsert against a row-by-row statement of the rule on random configurations."""

import datetime as dt
import random
from decimal import Decimal, localcontext

from meterkit.operators import catalog

T = dt.datetime.fromisoformat
PRICE_SCHEMA = (
    "uuid string, item_id string, price decimal(38,12), valid_from timestamp_ntz, valid_until timestamp_ntz, "
    "configured_at timestamp_ntz"
)
CONFIG_SCHEMA = "seq long, sku string, valid_from timestamp_ntz, price double"


def items_df(spark, rows=(("i1", "sku1", "n1", "u1"), ("i2", "sku2", "n2", "u2"))):
    return spark.createDataFrame(list(rows), "uuid string, sku string, name string, unit string")


def test_g10_items(spark):
    it = items_df(spark, [("i2", "b", "", ""), ("i1", "a", "", "")])
    assert [r.sku for r in catalog.list_items(it).collect()] == ["a", "b"]
    assert catalog.item_by_sku(it, "b").collect()[0].uuid == "i2"
    assert catalog.item_by_sku(it, "zzz").count() == 0


def test_g7_prices_at_now(spark):
    prices = spark.createDataFrame(
        [
            ("p1", "i1", Decimal("2.30"), T("2023-01-16"), T("2024-01-16"), T("2023-01-01")),
            ("p2", "i1", Decimal("2.34"), T("2024-01-16"), None, T("2024-01-01")),
            ("p3", "i2", Decimal("0.000000412"), T("2023-01-16"), None, T("2023-01-01")),
        ],
        PRICE_SCHEMA,
    )
    got = [(r.sku, r.price) for r in catalog.prices_at(prices, items_df(spark), "2025-06-01 00:00:00").collect()]
    assert got == [("sku1", Decimal("2.34")), ("sku2", Decimal("0.000000412"))]


def test_g8_config_update(spark):
    it = items_df(spark, [("i1", "my-sku", "my product", "GB-s")])
    empty = spark.createDataFrame([], PRICE_SCHEMA)
    first = spark.createDataFrame([(1, "my-sku", T("2025-01-01"), 12.34)], CONFIG_SCHEMA)
    p1, rej = catalog.apply_price_config(empty, it, first, "2025-01-01 00:00:00")
    assert rej.count() == 0
    it2 = catalog.upsert_items(it, spark.createDataFrame([("my-sku", "renamed", None)], "sku string, name string, unit string"))
    assert [(r.name, r.unit) for r in it2.collect()] == [("renamed", "GB-s")]
    second = spark.createDataFrame([(1, "my-sku", T("2025-01-01"), 12.35), (2, "my-sku", T("2025-01-02"), 11.0)], CONFIG_SCHEMA)
    p2, rej = catalog.apply_price_config(p1, it2, second, "2025-01-05 00:00:00")
    got = sorted((r.price, r.valid_from, r.valid_until) for r in p2.collect())
    assert got == [
        (Decimal("11.000000000000"), T("2025-01-02"), None),
        (Decimal("12.350000000000"), T("2025-01-01"), T("2025-01-02")),
    ]


def test_price_rejects_abort_load(spark):
    it = items_df(spark)
    prices = spark.createDataFrame([("p", "i1", Decimal("1"), T("2025-01-10"), None, T("2025-01-10"))], PRICE_SCHEMA)
    cfg = spark.createDataFrame([(1, "nosku", T("2025-02-01"), 1.0), (2, "sku1", T("2025-01-05"), 2.0)], CONFIG_SCHEMA)
    table, rej = catalog.apply_price_config(prices, it, cfg, "2025-03-01 00:00:00")
    assert sorted(r.reason for r in rej.collect()) == ["unknown_sku", "valid_from_before_latest"]
    assert table.count() == 1


def _rowwise(existing, config):
    """Row-by-row statement of the configuration rule for one SKU (existing: list of dicts)."""
    rows = [dict(r) for r in existing]
    for c in sorted(config, key=lambda c: c["seq"]):
        hits = [r for r in rows if r["valid_from"] == c["valid_from"]]
        if hits:
            for r in hits:
                r["price"] = c["price"]
            continue
        if rows:
            latest = max(rows, key=lambda r: (r["valid_from"], r["configured_at"]))
            if latest["valid_from"] > c["valid_from"]:
                return None
            latest["valid_until"] = c["valid_from"]
        rows.append({"valid_from": c["valid_from"], "valid_until": None, "price": c["price"], "configured_at": T("2030-01-01")})
    return sorted((r["valid_from"], r["valid_until"], round(float(r["price"]), 6)) for r in rows)


def test_price_upsert_matches_rowwise_rule(spark):
    rnd = random.Random(7)
    it = items_df(spark, [("i1", "sku1", "", "")])
    for trial in range(12):
        days = sorted(rnd.sample(range(1, 40), rnd.randint(0, 4)))
        existing = []
        for n, d in enumerate(days):
            existing.append(
                {
                    "valid_from": T("2025-01-01") + dt.timedelta(days=d),
                    "valid_until": (T("2025-01-01") + dt.timedelta(days=days[n + 1])) if n + 1 < len(days) else None,
                    "price": Decimal(n + 1),
                    "configured_at": T("2024-12-01"),
                }
            )
        config = [
            {"seq": s, "valid_from": T("2025-01-01") + dt.timedelta(days=rnd.randint(1, 50)), "price": float(rnd.randint(1, 9))}
            for s in range(rnd.randint(1, 4))
        ]
        prices = spark.createDataFrame(
            [(f"p{n}", "i1", r["price"], r["valid_from"], r["valid_until"], r["configured_at"]) for n, r in enumerate(existing)],
            PRICE_SCHEMA,
        )
        cfg = spark.createDataFrame([(c["seq"], "sku1", c["valid_from"], c["price"]) for c in config], CONFIG_SCHEMA)
        table, rej = catalog.apply_price_config(prices, it, cfg, "2030-01-01 00:00:00")
        expected = _rowwise(existing, config)
        if expected is None:
            assert rej.count() > 0, trial
        else:
            assert rej.count() == 0, trial
            got = sorted((r.valid_from, r.valid_until, round(float(r.price), 6)) for r in table.collect())
            assert got == expected, (trial, config, existing)


def test_pricing_uses_latest_configured_price(spark):
    prices = spark.createDataFrame(
        [
            ("a", "i1", Decimal("1"), T("2025-01-01"), T("2025-01-10"), T("2025-01-01")),
            ("b", "i1", Decimal("2"), T("2025-01-10"), None, T("2025-01-10")),
            ("c", "i1", Decimal("5"), T("2025-01-05"), T("2025-01-12"), T("2025-02-01")),
        ],
        PRICE_SCHEMA,
    )
    events = spark.createDataFrame(
        [(f"e{d}", T("2025-01-01") + dt.timedelta(days=d), T("2025-01-01") + dt.timedelta(days=d), "i1", "w", 2.0) for d in (0, 5, 10, 12, 40)]
        + [("x", T("2024-01-01"), T("2024-01-01"), "i1", "w", 1.0)],
        "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, workspace string, quantity double",
    )
    got = {r.uuid: (r.price_id, r.charge) for r in catalog.price_usage(events, prices).collect()}
    assert got == {"e0": ("a", 2.0), "e5": ("c", 10.0), "e10": ("c", 10.0), "e12": ("b", 4.0), "e40": ("b", 4.0), "x": (None, None)}
    eff = catalog.effective_prices(prices, items_df(spark), "2025-01-06 00:00:00").collect()
    assert [(r.uuid, r.sku) for r in eff] == [("c", "sku1")]
    known = catalog.effective_prices(prices, items_df(spark), "2025-01-06 00:00:00", known_at="2025-01-15 00:00:00").collect()
    assert [r.uuid for r in known] == ["a"]


EVENT = "uuid string, event_start timestamp_ntz, event_end timestamp_ntz, item_id string, workspace string, quantity double"


def test_charges_are_exact(spark):
    cases = [(1e13, "2.5"), (0.01, "0.000000412"), (5e-7, "1000000"), (123456789.123456, "99999999.999999999999"), (-3.0, "0.5"), (0.0, "7"), (1e19, "100"), (float("nan"), "1"), (1e-15, "0.001"), (2.0, "100000000")]
    prices = spark.createDataFrame([(f"p{n}", f"i{n}", Decimal(p), T("2025-01-01"), None, T("2025-01-01")) for n, (_, p) in enumerate(cases)], PRICE_SCHEMA)
    events = spark.createDataFrame([(f"e{n}", T("2025-01-02"), T("2025-01-02"), f"i{n}", "w", q) for n, (q, _) in enumerate(cases)] + [("x", T("2025-01-02"), T("2025-01-02"), "no", "w", 1.0)], EVENT)
    got = {r.uuid: (r.charge, r.charge_reason) for r in catalog.price_usage(events, prices).collect()}
    for n, (q, p) in enumerate(cases):
        charge, reason = got[f"e{n}"]
        if n in (6, 7, 9):  # beyond 20 digits before the point, no number, a price of 10^8
            assert charge is None and reason == "out_of_range", n
        else:
            with localcontext() as c:
                c.prec = 80
                exact = Decimal(repr(q)) * Decimal(p)
                assert reason is None and abs(charge - exact) <= Decimal("0.5e-18"), (n, charge, exact)
    assert got["x"] == (None, "no_price")


def test_unmapped_workspaces_are_charged_to_no_account(spark):
    prices = spark.createDataFrame([("p", "i", Decimal("2"), T("2025-01-01"), None, T("2025-01-01"))], PRICE_SCHEMA)
    events = spark.createDataFrame([(f"e{n}", T("2025-01-02"), T("2025-01-02"), i, w, 1.5) for n, (i, w) in enumerate([("i", "w1"), ("i", "w2"), ("no", "w2")])], EVENT)
    accounts = spark.createDataFrame([("w1", "a")], "workspace string, account string")
    got = {r.account: (r.charge, r.events, r.uncharged) for r in catalog.account_charges(catalog.price_usage(events, prices), accounts).collect()}
    assert got == {"a": (Decimal(3), 1, 0), None: (Decimal(3), 2, 1)}


def test_price_pieces_equal_the_plain_rule(spark):
    rnd = random.Random(12)
    rows = []
    for n in range(150):
        start = T("2025-01-01") + dt.timedelta(days=rnd.randint(0, 60))
        end = None if rnd.random() < 0.2 else start + dt.timedelta(days=rnd.randint(0, 40))
        rows.append((f"p{n:03d}", f"i{n % 4}", Decimal(n), start, end, T("2025-01-01") + dt.timedelta(days=rnd.randint(0, 9))))
    got = {(r.item_id, r.piece_start): (r.piece_end, r.price_id) for r in catalog.price_timeline(spark.createDataFrame(rows, PRICE_SCHEMA)).collect()}
    want = {}
    for item in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == item]
        points = sorted({p for r in mine for p in r[3:5] if p})
        for a, b in zip(points, [*points[1:], None]):
            live = [r for r in mine if r[3] <= a and (r[4] is None or a < r[4])]
            if live:
                want[item, a] = (b, min(live, key=lambda r: (-r[5].timestamp(), -r[3].timestamp(), r[0]))[0])
    assert got == want


def test_many_overlapping_prices_of_one_item(spark):
    """100,000 prices of one item that all overlap: pairing prices with pieces would make 10^10 rows."""
    n = 100_000
    base = spark.range(n).selectExpr(
        "concat('p', id) uuid", "'i' item_id", "cast(id as decimal(38,12)) price",
        "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) valid_from",
        "timestamp_ntz'2025-06-01 00:00:00' + make_dt_interval(0, 0, 0, id) valid_until",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 7919) % 100000) configured_at",
    )
    pieces = catalog.price_timeline(base)
    # the piece that starts where all prices hold takes the latest configured one
    full = pieces.where("piece_start = timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, 99999)").collect()
    best = max(range(n), key=lambda i: (i * 7919) % 100000)
    assert [r.price_id for r in full] == [f"p{best}"]
