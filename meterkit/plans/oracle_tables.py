"""DuckDB statements of the testdata mapping (FIXTURES.md part 2), used as CTEs by the oracle SQL.

They restate ``meterkit.sources.testmap`` independently in plain SQL over the
pre-registered views (``events``, ``customer``).
"""

from __future__ import annotations


def U(expr: str) -> str:
    m = f"md5({expr})"
    return (
        f"(substr({m},1,8)||'-'||substr({m},9,4)||'-'||substr({m},13,4)||'-'"
        f"||substr({m},17,4)||'-'||substr({m},21,12))"
    )


DAY = 86_400_000_000
HOUR = 3_600_000_000
SEC = 1_000_000

_START_US = f"(epoch_us(ts) + (event_id % 3) * 30 * {DAY})"
_END_US = f"({_START_US} + (event_id % 13) * 600 * {SEC})"
_USER = f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {U(chr(39) + 'u:' + chr(39) + ' || CAST(user_id AS VARCHAR)')} END"

CTES: dict[str, str] = {
    "billing_item": f"""
billing_item AS (
  SELECT {U("'item:' || sku")} AS uuid, sku, 'Item ' || sku AS name, 'unit-s' AS unit
  FROM (SELECT DISTINCT event_type AS sku FROM events) s
)""",
    "billing_event": f"""
billing_event AS (
  SELECT {U("'ev:' || CAST(event_id AS VARCHAR)")} AS uuid,
         make_timestamp({_START_US}) AS event_start,
         make_timestamp({_END_US}) AS event_end,
         {U("'item:' || event_type")} AS item_id,
         {_USER} AS "user",
         'ws-' || CAST(user_id AS VARCHAR) AS workspace,
         value AS quantity
  FROM events
)""",
    "rate_sample": f"""
rate_sample AS (
  SELECT {U("'rs:' || CAST(event_id AS VARCHAR)")} AS uuid,
         ts AS sample_time,
         {U("'item:' || event_type")} AS item_id,
         {_USER} AS "user",
         'ws-' || CAST(user_id AS VARCHAR) AS workspace,
         value AS rate
  FROM events
)""",
    "sample_arrivals": f"""
sample_arrivals AS (
  SELECT {U("'rs:' || CAST(event_id AS VARCHAR)")} AS uuid,
         make_timestamp(epoch_us(ts) + CASE WHEN event_id % 17 = 0 THEN 2 * {DAY} ELSE 0 END) AS arrived_at
  FROM events
)""",
    "message_copies": """
message_copies AS (
  SELECT event_id, ts, user_id, event_type, value, event_id * 2 AS ingest_seq FROM events
  UNION ALL
  SELECT event_id, ts, user_id, event_type, value + 100, event_id * 2 + 1 FROM events WHERE event_id % 7 = 0
)""",
    "workspace_account": f"""
workspace_account AS (
  SELECT 'ws-' || CAST(c_custkey AS VARCHAR) AS workspace,
         {U("'acct:' || CAST(c_nationkey AS VARCHAR)")} AS account
  FROM customer WHERE c_custkey % 10 <> 9
)""",
    "workspace_messages": f"""
workspace_messages AS (
  SELECT 'ws-' || CAST(c_custkey AS VARCHAR) AS name,
         {U("'acct:' || CAST(c_nationkey AS VARCHAR)")} AS account,
         c_custkey * 2 AS ingest_seq
  FROM customer
  UNION ALL
  SELECT 'ws-' || CAST(c_custkey AS VARCHAR),
         {U("'acct:' || CAST((c_nationkey + 1) % 25 AS VARCHAR)")},
         c_custkey * 2 + 1
  FROM customer WHERE c_custkey % 4 = 0
)""",
    "billing_item_price": f"""
billing_item_price AS (
  SELECT {U("'price:' || sku || ':' || CAST(k AS VARCHAR)")} AS uuid,
         uuid AS item_id,
         CAST(CAST((k + 1) * length(sku) AS DOUBLE) / 100 AS DECIMAL(38,12)) AS price,
         make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + k * 10 * {DAY}) AS valid_from,
         CASE WHEN k < 8 THEN make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (k + 1) * 10 * {DAY}) END
           AS valid_until,
         make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + k * 10 * {DAY}) AS configured_at
  FROM (SELECT uuid, sku, unnest(range(0, 9)) AS k FROM billing_item) bk
  UNION ALL
  SELECT {U("'price:' || sku || ':c'")}, uuid,
         CAST(CAST(2 * length(sku) + 1 AS DOUBLE) / 100 AS DECIMAL(38,12)),
         TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-12'
  FROM billing_item
)""",
    "entitlements": f"""
entitlements AS (
  SELECT 'user-' || CAST(c_nationkey AS VARCHAR) AS principal, 'workspace' AS kind,
         'ws-' || CAST(c_custkey AS VARCHAR) AS target,
         CASE WHEN c_custkey % 3 = 0 THEN 'owner' ELSE 'member' END AS role
  FROM customer
  UNION ALL
  SELECT DISTINCT 'user-' || CAST(c_nationkey AS VARCHAR), 'account',
         {U("'acct:' || CAST(c_nationkey AS VARCHAR)")}, 'owner'
  FROM customer
  UNION ALL
  SELECT DISTINCT 'user-0', 'global', NULL, 'hub_admin' FROM customer WHERE c_nationkey = 0
)""",
    "requested_intervals": f"""
requested_intervals AS (
  SELECT {U("'iv:' || CAST(event_id AS VARCHAR)")} AS interval_id,
         'ws-' || CAST(user_id AS VARCHAR) AS workspace,
         {U("'item:' || event_type")} AS item_id,
         make_timestamp(epoch_us(ts) - {90 * 60 * SEC}) AS start,
         make_timestamp(epoch_us(ts) + {45 * 60 * SEC}) AS "end"
  FROM events
)""",
}

# the CTEs each entry needs before it
_DEPS = {"billing_item_price": ["billing_item"]}


def with_tables(names: list[str], body: str) -> str:
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    return "WITH " + ",".join(CTES[n] for n in ordered) + "\n" + body
