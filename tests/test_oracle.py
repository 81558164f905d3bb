"""Every registered query against its DuckDB oracle SQL on the smallest testdata
(rows, column names and an order-insensitive value hash)."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import compare  # noqa: E402

from meterkit.plans.queries import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF, sorted(queries()), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad
    assert len(res) >= 45


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert {"uuid", "workspace", "sku", "event_start", "event_end", "quantity"} <= set(df.columns)
