"""Oracle SQL (DuckDB) for every registered query: an independent plain-SQL statement of the
same semantics over the pre-registered testdata views."""

from __future__ import annotations

from meterkit.plans import queries as q
from meterkit.plans.oracle_tables import DAY, HOUR, SEC, U, with_tables

NS_HEX = "67f9a35c567c4a30b51d2fc64328bd55"  # estimate-id namespace (same fixed value as the library)


def _ts(s: str) -> str:
    return f"TIMESTAMP '{s}'"


def _iso(ts: str) -> str:
    """Python isoformat() of an aware UTC value."""
    frac = f"epoch_us({ts}) % {SEC}"
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {frac} <> 0 THEN '.' || lpad(CAST({frac} AS VARCHAR), 6, '0') "
        f"ELSE '' END || '+00:00')"
    )


def _uuid5(name: str) -> str:
    d = f"sha1(unhex('{NS_HEX}') || encode({name}))"
    h = (
        f"(substr({d},1,12) || '5' || substr({d},14,3) || translate(substr({d},17,1), '0123456789abcdef', "
        f"'89ab89ab89ab89ab') || substr({d},18,15))"
    )
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12))"


def _rate(x: str, t: str = "t", r: str = "r", nt: str = "nt", nr: str = "nr") -> str:
    return f"(CASE WHEN {x} = {nt} THEN {nr} WHEN {x} = {t} THEN {r} ELSE {r} + ((({x}) - {t}) / ({nt} - {t})) * ({nr} - {r}) END)"


def _area(a: str, e: str) -> str:
    lo = f"greatest(t, {a})"
    hi = f"least(nt, {e})"
    return (
        f"(CASE WHEN {hi} > {lo} THEN ((({hi}) - ({a})) // {SEC} - (({lo}) - ({a})) // {SEC}) * "
        f"(({_rate(lo)} + {_rate(hi)}) / 2.0) END)"
    )


_USAGE_COLS = 'e.uuid, e.event_start, e.event_end, e.item_id, i.sku, e."user", e.workspace, e.quantity'
_ORDER = "event_start, event_end, workspace, sku, uuid"

_SEGS = """
s AS (SELECT workspace, item_id, epoch_us(sample_time) AS t, uuid, rate AS r FROM rate_sample),
segs AS (
  SELECT workspace, item_id, t, r, uuid,
         lead(t) OVER w AS nt, lead(r) OVER w AS nr
  FROM s WINDOW w AS (PARTITION BY workspace, item_id ORDER BY t, uuid)
)"""


def _usage_sql(where: str = "", tail: str = "") -> str:
    body = f"""
SELECT {_USAGE_COLS}
FROM billing_event e JOIN billing_item i ON i.uuid = e.item_id
{('WHERE ' + where) if where else ''}
{tail}"""
    return with_tables(["billing_item", "billing_event", "workspace_account"], body)


def _agg_sql(period: str) -> str:
    if period == "day":
        start = f"make_timestamp((epoch_us(event_start) // {DAY}) * {DAY})"
        end = f"make_timestamp((epoch_us(event_start) // {DAY}) * {DAY} + {DAY})"
    else:
        start = "date_trunc('month', event_start)"
        end = "date_trunc('month', event_start) + INTERVAL 1 MONTH"
    return f"""
agg AS (
  SELECT max(uuid) AS uuid, {start} AS event_start, {end} AS event_end, item_id,
         CAST(NULL AS VARCHAR) AS "user", workspace, sum(quantity) AS quantity
  FROM billing_event GROUP BY 2, 3, item_id, workspace
)"""


def _agg_usage(period: str, where: str = "", tail: str = "") -> str:
    body = f"""
, {_agg_sql(period).strip()}
SELECT a.uuid, a.event_start, a.event_end, a.item_id, i.sku, a."user", a.workspace, round(a.quantity, 4) AS quantity
FROM agg a JOIN billing_item i ON i.uuid = a.item_id
{('WHERE ' + where) if where else ''}
{tail}"""
    return with_tables(["billing_item", "billing_event"], "").rstrip("\n") + body


def _estimates_sql(samples_where: str = "", resume_from_events: str | None = None, arrivals: bool = False) -> str:
    """Brute force: every window of every key joined with every segment overlapping it."""
    sw = f"WHERE {samples_where}" if samples_where else ""
    if resume_from_events is None:
        g = f"(min(t) // {HOUR}) * {HOUR}"
        keys = f"SELECT workspace, item_id, {g} AS g, max(t) // {HOUR} AS hu FROM s GROUP BY workspace, item_id"
    else:
        keys = f"""
SELECT k.workspace, k.item_id, coalesce(epoch_us(ev.last_end), k.g0) AS g, k.hu
FROM (SELECT workspace, item_id, (min(t) // {HOUR}) * {HOUR} AS g0, max(t) // {HOUR} AS hu FROM s GROUP BY 1, 2) k
LEFT JOIN (SELECT workspace, item_id, max(event_end) AS last_end FROM billing_event WHERE {resume_from_events} GROUP BY 1, 2) ev
USING (workspace, item_id)"""
    body = f""",
s AS (SELECT workspace, item_id, epoch_us(sample_time) AS t, uuid, rate AS r FROM rate_sample {sw}),
segs AS (
  SELECT workspace, item_id, t, r, lead(t) OVER w AS nt, lead(r) OVER w AS nr
  FROM s WINDOW w AS (PARTITION BY workspace, item_id ORDER BY t, uuid)
),
keys AS ({keys}),
win AS (
  SELECT workspace, item_id, greatest(g, h * {HOUR}) AS a, (h + 1) * {HOUR} AS e
  FROM (SELECT workspace, item_id, g, unnest(range(g // {HOUR}, hu)) AS h FROM keys)
),
contrib AS (
  SELECT w.workspace, w.item_id, w.a, w.e, {_area('w.a', 'w.e')} AS area
  FROM win w JOIN segs sg ON sg.workspace = w.workspace AND sg.item_id = w.item_id
   AND sg.nt IS NOT NULL AND sg.t < w.e AND sg.nt > w.a
),
est AS (
  SELECT w.workspace, w.item_id, w.a, w.e, coalesce(sum(c.area), 0) AS quantity
  FROM win w LEFT JOIN contrib c ON c.workspace = w.workspace AND c.item_id = w.item_id AND c.a = w.a
  GROUP BY w.workspace, w.item_id, w.a, w.e
),
named AS (
  SELECT est.*, i.sku, make_timestamp(est.a) AS event_start, make_timestamp(est.e) AS event_end
  FROM est LEFT JOIN billing_item i ON i.uuid = est.item_id
)
SELECT {_uuid5("workspace || '-' || sku || '-' || " + _iso('event_start'))} AS uuid,
       workspace, item_id, sku, event_start, event_end, quantity
FROM named"""
    tables = ["billing_item", "billing_event", "rate_sample"] + (["sample_arrivals"] if arrivals else [])
    return with_tables(tables, "").rstrip("\n") + body


_IV = f"""
iv AS (SELECT interval_id, workspace, item_id, epoch_us(start) AS a, epoch_us("end") AS e FROM requested_intervals)"""

_MSG_START = f"(epoch_us(ts) + (event_id % 3) * 30 * {DAY})"
_MSG_END = f"(CASE WHEN event_id % 103 = 0 THEN {_MSG_START} - {HOUR} ELSE {_MSG_START} + (event_id % 13) * 600 * {SEC} END)"
_MSG_SKU = "(CASE WHEN event_id % 11 = 0 THEN 'new-' || event_type ELSE event_type END)"
_MSG_USER = f"(CASE WHEN event_id % 5 = 0 THEN NULL ELSE {U(chr(39) + 'u:' + chr(39) + ' || CAST(user_id AS VARCHAR)')} END)"

_VALID_EVENTS = f"""
valid_events AS (
  SELECT {U("'ev:' || CAST(event_id AS VARCHAR)")} AS uuid,
         make_timestamp({_MSG_START}) AS event_start,
         make_timestamp({_MSG_END} + (ingest_seq % 2) * 8 * {HOUR}) AS event_end, {_MSG_SKU} AS sku, {_MSG_USER} AS "user", 'ws-' || CAST(user_id AS VARCHAR) AS workspace,
         value AS quantity, ingest_seq
  FROM message_copies WHERE event_id % 101 <> 0 AND event_id % 103 <> 0
)"""

_VALID_SAMPLES = f"""
valid_samples AS (
  SELECT {U("'rs:' || CAST(event_id AS VARCHAR)")} AS uuid,
         make_timestamp(epoch_us(ts) + (ingest_seq % 2) * 4 * {HOUR}) AS sample_time, {_MSG_SKU} AS sku, {_MSG_USER} AS "user", 'ws-' || CAST(user_id AS VARCHAR) AS workspace,
         value AS rate, ingest_seq
  FROM message_copies WHERE event_id % 101 <> 0
)"""

_PRICE_CONFIG_ROWS = [
    (1, "sku", "2024-03-21", "9.99"),
    (2, "sku", "2024-04-01", "CAST(length(sku) AS DOUBLE)"),
    (3, "sku", "2024-01-11", "1.5"),
    (4, "sku", "2024-04-01", "CAST(length(sku) AS DOUBLE) + 0.5"),
    (5, "sku", "2024-04-15", "2.0"),
]
_PRICE_CONFIG_BAD = [(6, "'nosuch-' || sku", "2024-05-01", "1.0"), (7, "sku", "2024-02-05", "3.0")]


def _price_config(bad: bool) -> str:
    rows = _PRICE_CONFIG_ROWS + (_PRICE_CONFIG_BAD if bad else [])
    parts = [
        f"SELECT {seq} AS seq, {sku} AS sku, TIMESTAMP '{vf}' AS valid_from, CAST({price} AS DOUBLE) AS price FROM billing_item"
        for seq, sku, vf, price in rows
    ]
    return "price_config AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


_PRICE_CHECK = """
checked AS (
  SELECT c.*, i.uuid AS item_id,
         greatest(l.emax, max(c.valid_from) OVER (PARTITION BY c.sku ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS pm,
         count(*) OVER (PARTITION BY c.sku, c.valid_from ORDER BY c.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen,
         EXISTS (SELECT 1 FROM billing_item_price p WHERE p.item_id = i.uuid AND p.valid_from = c.valid_from) AS old
  FROM price_config c
  LEFT JOIN billing_item i ON i.sku = c.sku
  LEFT JOIN (SELECT item_id, max(valid_from) AS emax FROM billing_item_price GROUP BY item_id) l ON l.item_id = i.uuid
),
judged AS (
  SELECT *, CASE WHEN item_id IS NULL THEN 'unknown_sku'
                 WHEN valid_from IS NULL OR price IS NULL THEN 'missing_field'
                 WHEN NOT old AND NOT seen AND pm IS NOT NULL AND valid_from < pm THEN 'valid_from_before_latest'
            END AS reason
  FROM checked
)"""


def oracle_sql() -> dict[str, str]:
    ws = f"'{q.WORKSPACE}'"
    rs, re_ = _ts(q.RANGE_START), _ts(q.RANGE_END)
    acct = f"'{q.ACCOUNT}'"
    out: dict[str, str] = {}

    out["usage_raw"] = _usage_sql()
    out["usage_by_workspace"] = _usage_sql(f"e.workspace = {ws}")
    out["usage_by_account"] = _usage_sql(
        f"e.workspace IN (SELECT workspace FROM workspace_account WHERE account = {acct})"
    )
    out["usage_range"] = _usage_sql(f"e.event_start >= {rs} AND e.event_end < {re_}")
    out["usage_overlap"] = _usage_sql(f"e.event_end > {rs} AND e.event_start < {re_}")
    out["usage_page"] = _usage_sql("", f"ORDER BY {_ORDER} LIMIT {q.PAGE_SIZE}")
    out["usage_page_after"] = _usage_sql("", f"ORDER BY {_ORDER} LIMIT {q.PAGE_SIZE} OFFSET {q.PAGE_SIZE}")
    out["usage_page_foreign_cursor"] = f"""
WITH every AS ({_usage_sql()}),
c AS (SELECT {_ORDER} FROM every ORDER BY {_ORDER} LIMIT 1 OFFSET {q.PAGE_SIZE - 1})
SELECT e.* FROM every e, c WHERE e.workspace = {ws}
  AND (e.event_start, e.event_end, e.workspace, e.sku, e.uuid) > (c.event_start, c.event_end, c.workspace, c.sku, c.uuid)
ORDER BY e.event_start, e.event_end, e.workspace, e.sku, e.uuid LIMIT {q.PAGE_SIZE}"""
    out["usage_daily"] = _agg_usage("day")
    out["usage_monthly"] = _agg_usage("month")
    a0, a1 = _ts(q.AGG_RANGE[0]), _ts(q.AGG_RANGE[1])
    out["usage_daily_page"] = _agg_usage(
        "day",
        f"a.workspace = {ws} AND a.event_start >= {a0} AND a.event_end < {a1}",
        f"ORDER BY {_ORDER} LIMIT {q.AGG_PAGE_SIZE} OFFSET {q.AGG_PAGE_SIZE}",
    )
    out["usage_export"] = with_tables(
        ["billing_item", "billing_event"],
        f"""
SELECT e.uuid, strftime(e.event_start, '%Y-%m-%dT%H:%M:%SZ') AS event_start,
       strftime(e.event_end, '%Y-%m-%dT%H:%M:%SZ') AS event_end, i.sku AS item, e.workspace, e.quantity
FROM billing_event e JOIN billing_item i ON i.uuid = e.item_id WHERE e.workspace = {ws}""",
    )
    out["latest_event"] = with_tables(
        ["billing_event"],
        """
SELECT uuid, event_start, event_end, item_id, "user", workspace, quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace, item_id ORDER BY event_end DESC, uuid DESC) AS rn
  FROM billing_event) WHERE rn = 1""",
    )
    out["earliest_sample"] = with_tables(
        ["rate_sample"],
        """
SELECT uuid, sample_time, item_id, "user", workspace, rate FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace, item_id ORDER BY sample_time, uuid) AS rn
  FROM rate_sample) WHERE rn = 1""",
    )
    out["compact_daily"] = with_tables(
        ["billing_event"],
        f"""
SELECT first(uuid ORDER BY event_start, uuid) AS uuid, min(event_start) AS event_start, max(event_end) AS event_end,
       item_id, "user", workspace, round(sum(quantity), 4) AS quantity, count(*) AS merged
FROM billing_event GROUP BY "user", workspace, item_id, epoch_us(event_start) // {DAY}""",
    )
    out["split_midnight"] = with_tables(
        ["billing_event"],
        f""",
x AS (SELECT *, epoch_us(event_start) AS s_us, epoch_us(event_end) AS e_us,
             epoch_us(event_start) // {DAY} AS d0, (epoch_us(event_end) - 1) // {DAY} AS d1 FROM billing_event),
p AS (SELECT *, unnest(range(d0, greatest(d0, d1) + 1)) AS d FROM x),
c AS (SELECT *, greatest(s_us, d * {DAY}) AS lo, least(e_us, (d + 1) * {DAY}) AS hi FROM p)
SELECT uuid, d - d0 AS part,
       CASE WHEN e_us = s_us THEN event_start ELSE make_timestamp(lo) END AS event_start,
       CASE WHEN e_us = s_us THEN event_end ELSE make_timestamp(hi) END AS event_end,
       item_id, "user", workspace,
       round(CASE WHEN e_us = s_us THEN quantity ELSE quantity * ((hi - lo) / (e_us - s_us)) END, 4) AS quantity
FROM c""",
    ).replace("\n,\nx AS", ",\nx AS")

    # ---- time series
    out["interval_samples"] = with_tables(
        ["rate_sample", "requested_intervals"],
        f""",
{_IV.strip()},
s AS (SELECT workspace, item_id, epoch_us(sample_time) AS t, uuid, sample_time, rate FROM rate_sample),
j AS (SELECT iv.interval_id, iv.a, iv.e, s.* FROM iv JOIN s USING (workspace, item_id))
SELECT interval_id, uuid, sample_time, rate FROM j WHERE t > a AND t < e
UNION
SELECT interval_id, uuid, sample_time, rate FROM (
  SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY t DESC, uuid DESC) AS rn FROM j WHERE t <= a) WHERE rn = 1
UNION
SELECT interval_id, uuid, sample_time, rate FROM (
  SELECT *, row_number() OVER (PARTITION BY interval_id ORDER BY t ASC, uuid ASC) AS rn FROM j WHERE t >= e) WHERE rn = 1""",
    )
    out["rate_at"] = with_tables(
        ["rate_sample", "requested_intervals"],
        f""",
{_IV.strip()},{_SEGS},
j AS (SELECT iv.interval_id, iv.a AS x, sg.t, sg.r, sg.nt, sg.nr,
             row_number() OVER (PARTITION BY iv.interval_id ORDER BY sg.t DESC, sg.uuid DESC) AS rn
      FROM iv JOIN segs sg USING (workspace, item_id) WHERE sg.t <= iv.a)
SELECT iv.interval_id,
       round(CASE WHEN j.x = j.t THEN j.r WHEN j.nt IS NOT NULL THEN {_rate('j.x', 'j.t', 'j.r', 'j.nt', 'j.nr')} END, 6) AS rate
FROM iv LEFT JOIN (SELECT * FROM j WHERE rn = 1) j ON j.interval_id = iv.interval_id""",
    )
    out["consumption_interval"] = with_tables(
        ["rate_sample", "requested_intervals"],
        f""",
{_IV.strip()},{_SEGS},
ov AS (SELECT iv.interval_id, iv.a, iv.e, sg.t, sg.r, sg.nt, sg.nr
       FROM iv JOIN segs sg USING (workspace, item_id)
       WHERE sg.nt IS NOT NULL AND sg.t < iv.e AND sg.nt > iv.a),
tot AS (SELECT interval_id, sum(coalesce({_area('a', 'e')}, 0)) AS consumption FROM ov GROUP BY interval_id)
SELECT r.interval_id, r.workspace, r.item_id, r.start, r."end", round(tot.consumption, 4) AS consumption
FROM requested_intervals r LEFT JOIN tot ON tot.interval_id = r.interval_id""",
    )
    out["hourly_estimates"] = _estimates_sql().replace(
        "quantity\nFROM named", "round(quantity, 4) AS quantity\nFROM named"
    )
    out["resume_estimates"] = _estimates_sql(resume_from_events=f"event_end <= {_ts(q.RESUME_AS_OF)}").replace(
        "quantity\nFROM named", "round(quantity, 4) AS quantity\nFROM named"
    )
    stored = _estimates_sql(
        f"uuid IN (SELECT uuid FROM sample_arrivals WHERE arrived_at < {_ts(q.ESTIMATED_UNTIL)})", arrivals=True
    )
    now = _estimates_sql()
    out["estimate_drift"] = f"""
WITH stored AS ({stored}),
now AS ({now})
SELECT st.uuid, st.workspace, st.item_id, st.event_start, round(st.quantity, 4) AS stored_quantity,
       round(n.quantity, 4) AS recomputed_quantity
FROM stored st LEFT JOIN now n ON n.uuid = st.uuid
WHERE n.quantity IS NULL OR abs(st.quantity - n.quantity) > 1e-6"""
    out["estimate_ids"] = with_tables(
        ["billing_item", "billing_event"],
        f"""
SELECT e.uuid, {_uuid5("e.workspace || '-' || i.sku || '-' || " + _iso('e.event_start'))} AS estimate_id
FROM billing_event e JOIN billing_item i ON i.uuid = e.item_id""",
    )
    out["resume_points"] = with_tables(
        ["billing_event", "rate_sample"],
        f"""
SELECT s.workspace, s.item_id, coalesce(ev.last_end, make_timestamp((s.first_us // {HOUR}) * {HOUR})) AS resume_at
FROM (SELECT workspace, item_id, min(epoch_us(sample_time)) AS first_us FROM rate_sample GROUP BY 1, 2) s
LEFT JOIN (SELECT workspace, item_id, max(event_end) AS last_end FROM billing_event GROUP BY 1, 2) ev
USING (workspace, item_id)""",
    )

    # ---- items and prices
    out["items"] = with_tables(["billing_item"], "\nSELECT uuid, sku, name, unit FROM billing_item")
    out["item_by_sku"] = with_tables(["billing_item"], f"\nSELECT uuid, sku, name, unit FROM billing_item WHERE sku = '{q.SKU}'")
    at = _ts(q.PRICE_AT)
    valid = f"p.valid_from <= {at} AND (p.valid_until IS NULL OR p.valid_until > {at})"
    cols = "p.uuid, i.sku, p.item_id, p.price, p.valid_from, p.valid_until, p.configured_at"
    out["prices_at"] = with_tables(
        ["billing_item_price"],
        f"\nSELECT {cols} FROM billing_item_price p JOIN billing_item i ON i.uuid = p.item_id WHERE {valid}",
    )

    def eff(extra: str = "") -> str:
        return with_tables(
            ["billing_item_price"],
            f"""
SELECT uuid, sku, item_id, price, valid_from, valid_until, configured_at FROM (
  SELECT {cols}, row_number() OVER (PARTITION BY p.item_id ORDER BY p.configured_at DESC, p.valid_from DESC, p.uuid) AS rn
  FROM billing_item_price p JOIN billing_item i ON i.uuid = p.item_id WHERE {valid} {extra}) WHERE rn = 1""",
        )

    out["effective_price"] = eff()
    out["price_known_at"] = eff(f"AND p.configured_at <= {_ts(q.KNOWN_AT)}")
    # the whole and the broken part of the quantity are priced apart
    priced = """
priced AS (
  SELECT uuid, event_start, event_end, item_id, workspace, quantity, price_id, price,
         CAST(CAST(trunc(q) AS DECIMAL(18,0)) * CAST(price AS DECIMAL(18,12)) AS DECIMAL(38,18))
           + CAST(CAST(q - trunc(q) AS DECIMAL(18,18)) * CAST(price AS DECIMAL(18,12)) AS DECIMAL(38,18)) AS charge,
         CASE WHEN price_id IS NULL THEN 'no_price' END AS charge_reason FROM (
    SELECT e.*, CAST(CAST(e.quantity AS VARCHAR) AS DECIMAL(36,18)) AS q, p.uuid AS price_id, p.price,
           row_number() OVER (PARTITION BY e.uuid ORDER BY p.configured_at DESC, p.valid_from DESC, p.uuid) AS rn
    FROM billing_event e LEFT JOIN billing_item_price p
      ON p.item_id = e.item_id AND p.valid_from <= e.event_start
     AND (p.valid_until IS NULL OR e.event_start < p.valid_until)) WHERE rn = 1
)"""
    out["priced_usage"] = with_tables(
        ["billing_item_price", "billing_event"],
        f""",{priced}
SELECT uuid, event_start, event_end, item_id, workspace, quantity, price_id, price, charge, charge_reason FROM priced""",
    )
    out["account_charges"] = with_tables(
        ["billing_item_price", "billing_event", "workspace_account"],
        f""",{priced}
SELECT a.account, date_trunc('month', p.event_start) AS month, CAST(sum(p.charge) AS DECIMAL(38,18)) AS charge, count(*) AS events,
       count(p.charge_reason) AS uncharged
FROM priced p LEFT JOIN workspace_account a ON a.workspace = p.workspace GROUP BY 1, 2""",
    )
    out["item_upsert"] = with_tables(
        ["billing_item"],
        f""",
config AS (
  SELECT sku, CASE WHEN length(sku) % 2 = 0 THEN upper(sku) END AS name,
         CASE WHEN length(sku) % 2 <> 0 THEN 'unit-h' END AS unit FROM billing_item
  UNION ALL
  SELECT 'cfg-' || sku, 'Config ' || sku, 'unit-m' FROM billing_item
)
SELECT coalesce(i.uuid, {U("'item:' || c.sku")}) AS uuid, coalesce(i.sku, c.sku) AS sku,
       coalesce(c.name, i.name) AS name, coalesce(c.unit, i.unit) AS unit
FROM billing_item i FULL OUTER JOIN config c ON c.sku = i.sku
WHERE i.uuid IS NOT NULL OR (c.name IS NOT NULL AND c.unit IS NOT NULL)""",
    )
    out["item_upsert_repeated"] = with_tables(
        ["billing_item"],
        f"""
SELECT uuid, sku, 'Last ' || sku AS name, 'unit-d' AS unit FROM billing_item
UNION ALL
SELECT {U("'item:cfg-' || sku")}, 'cfg-' || sku, 'Last cfg-' || sku, 'unit-d' FROM billing_item""",
    )
    out["price_check"] = with_tables(
        ["billing_item_price"],
        """
SELECT uuid, valid_until AS valid_from, valid_from AS valid_until FROM billing_item_price WHERE valid_until > valid_from""",
    )
    out["items_export"] = with_tables(["billing_item"], "SELECT uuid, sku, name, unit FROM billing_item")
    out["prices_export"] = with_tables(
        ["billing_item_price"],
        f"""
SELECT p.uuid, i.sku, strftime(p.valid_from, '%Y-%m-%dT%H:%M:%SZ') AS valid_from,
       strftime(p.valid_until, '%Y-%m-%dT%H:%M:%SZ') AS valid_until, CAST(p.price AS DOUBLE) AS price
FROM billing_item_price p JOIN billing_item i ON i.uuid = p.item_id
WHERE p.valid_from <= {_ts(q.PRICE_AT)} AND (p.valid_until IS NULL OR p.valid_until > {_ts(q.PRICE_AT)})""",
    )
    out["price_rejects"] = with_tables(
        ["billing_item_price"],
        f""",
{_price_config(True)},{_PRICE_CHECK}
SELECT sku, valid_from, price, reason FROM judged WHERE reason IS NOT NULL""",
    )
    out["price_upsert"] = with_tables(
        ["billing_item_price"],
        f""",
{_price_config(False)},{_PRICE_CHECK},
last AS (
  SELECT item_id, valid_from, arg_max(price, seq) AS new_price FROM judged WHERE reason IS NULL GROUP BY 1, 2
),
allp AS (
  SELECT p.uuid, p.item_id, coalesce(CAST(l.new_price AS DECIMAL(38,12)), p.price) AS price, p.valid_from,
         p.valid_until, p.configured_at, false AS is_new
  FROM billing_item_price p LEFT JOIN last l ON l.item_id = p.item_id AND l.valid_from = p.valid_from
  UNION ALL
  SELECT {U("'price:' || l.item_id || ':' || strftime(l.valid_from, '%Y-%m-%d %H:%M:%S')")}, l.item_id,
         CAST(l.new_price AS DECIMAL(38,12)), l.valid_from, CAST(NULL AS TIMESTAMP),
         {_ts(q.CONFIGURED_AT)}, true
  FROM last l WHERE NOT EXISTS (SELECT 1 FROM billing_item_price p WHERE p.item_id = l.item_id AND p.valid_from = l.valid_from)
),
nxt AS (
  SELECT item_id, valid_from, lead(valid_from) OVER w AS next_from, lead(is_new) OVER w AS next_is_new
  FROM (SELECT DISTINCT item_id, valid_from, is_new FROM allp) WINDOW w AS (PARTITION BY item_id ORDER BY valid_from)
),
ranked AS (
  SELECT a.*, n.next_from, n.next_is_new,
         row_number() OVER (PARTITION BY a.item_id, a.valid_from ORDER BY a.configured_at DESC, a.uuid) AS rk
  FROM allp a LEFT JOIN nxt n ON n.item_id = a.item_id AND n.valid_from = a.valid_from
)
SELECT uuid, item_id, price, valid_from,
       CASE WHEN coalesce(next_is_new, false) AND (rk = 1 OR is_new) THEN next_from ELSE valid_until END AS valid_until,
       configured_at
FROM ranked""",
    )

    # ---- ingest
    stored_before = _ts(q.STORED_BEFORE)
    out["ingest_events"] = with_tables(["message_copies"], f""",{_VALID_EVENTS}
SELECT uuid, event_start, event_end, sku, "user", workspace, quantity, ingest_seq FROM valid_events""")
    out["event_quarantine"] = with_tables(
        ["message_copies"],
        f"""
SELECT CASE WHEN event_id % 101 = 0 THEN 'bad-' || CAST(event_id AS VARCHAR) ELSE {U("'ev:' || CAST(event_id AS VARCHAR)")} END AS uuid,
       ingest_seq,
       CASE WHEN event_id % 101 = 0 THEN 'bad_uuid' ELSE 'end_before_start' END AS reason
FROM message_copies WHERE event_id % 101 = 0 OR event_id % 103 = 0""",
    )
    out["ingest_events_json"] = with_tables(["message_copies"], f""",{_VALID_EVENTS}
SELECT uuid, event_start, event_end, sku, "user", workspace, quantity FROM valid_events""")
    out["quarantine_repair"] = with_tables(
        ["message_copies"],
        f"""
SELECT {U("'ev:' || CAST(event_id AS VARCHAR)")} AS uuid, make_timestamp({_MSG_START} - {HOUR}) AS event_start, make_timestamp({_MSG_START}) AS event_end,
       {_MSG_SKU} AS sku, {_MSG_USER} AS "user", 'ws-' || CAST(user_id AS VARCHAR) AS workspace, value AS quantity, ingest_seq
FROM message_copies WHERE event_id % 101 <> 0 AND event_id % 103 = 0""",
    )
    out["quarantine_bad_times"] = f"""
SELECT {U("'ev:' || CAST(event_id AS VARCHAR)")} AS uuid,
       CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) END AS event_start,
       make_timestamp(epoch_us(ts) + {DAY}) AS event_end, CASE WHEN event_id % 5 > 1 THEN 'bad_time' END AS reason
FROM events"""
    out["workspace_quarantine"] = with_tables(
        ["workspace_messages"],
        """
SELECT CASE WHEN ingest_seq % 13 = 0 THEN ' ' ELSE name END AS name, CASE WHEN ingest_seq % 17 = 0 THEN 'no-account' ELSE account END AS account,
       ingest_seq, CASE WHEN ingest_seq % 13 = 0 THEN 'missing_field' ELSE 'bad_account' END AS reason
FROM workspace_messages WHERE ingest_seq % 13 = 0 OR ingest_seq % 17 = 0""",
    )
    firsts = f"""
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ingest_seq) AS rn FROM valid_events) WHERE rn = 1)"""
    out["stream_events_replay"] = with_tables(
        ["billing_item", "billing_event", "message_copies"],
        f""",{_VALID_EVENTS},{firsts}
SELECT coalesce(s.workspace, k.workspace) AS workspace, coalesce(s.item_id, i.uuid, {U("'item:' || k.sku")}) AS item_id,
       max(coalesce(s.event_end, k.event_end)) AS resume_at
FROM kept k LEFT JOIN billing_item i ON i.sku = k.sku
LEFT JOIN billing_event s ON s.uuid = k.uuid AND s.event_end < {stored_before} GROUP BY 1, 2""",
    )
    out["stream_samples_replay"] = with_tables(
        ["billing_item", "rate_sample", "message_copies"],
        f""",{_VALID_SAMPLES},{firsts.replace("valid_events", "valid_samples")}
SELECT k.uuid, coalesce(s.sample_time, k.sample_time) AS sample_time, coalesce(s.item_id, i.uuid, {U("'item:' || k.sku")}) AS item_id,
       CASE WHEN s.uuid IS NOT NULL THEN s."user" ELSE k."user" END AS "user", coalesce(s.workspace, k.workspace) AS workspace,
       coalesce(s.rate, k.rate) AS rate
FROM kept k LEFT JOIN billing_item i ON i.sku = k.sku LEFT JOIN rate_sample s ON s.uuid = k.uuid AND s.sample_time < {stored_before}""",
    )
    until = f"epoch_us({_ts(q.UPTO)}) // {HOUR} * {HOUR}"
    out["estimates_upto"] = with_tables(
        ["rate_sample"],
        f""",{_SEGS},
k AS (SELECT workspace, item_id, min(t) // {HOUR} * {HOUR} AS lo FROM s GROUP BY 1, 2 HAVING min(t) // {HOUR} * {HOUR} < {until}),
w AS (SELECT k.workspace, k.item_id, k.lo, unnest(range(k.lo, {until}, {HOUR})) AS a FROM k),
p AS (SELECT w.workspace, w.item_id, w.a, {_area("a", f"(a + {HOUR})")} AS q
  FROM w JOIN segs x ON x.workspace = w.workspace AND x.item_id = w.item_id AND x.t < w.a + {HOUR} AND x.nt > w.a)
SELECT k.workspace, k.item_id, ({until} - k.lo) // {HOUR} AS windows, make_timestamp({until}) AS until,
       round(coalesce((SELECT sum(q) FROM p WHERE p.workspace = k.workspace AND p.item_id = k.item_id), 0), 2) AS quantity FROM k""",
    )
    out["events_resolved"] = with_tables(["billing_item", "message_copies"], f""",{_VALID_EVENTS}
SELECT v.uuid, v.sku, i.uuid AS item_id, v.ingest_seq FROM valid_events v LEFT JOIN billing_item i ON i.sku = v.sku""")
    out["stub_items"] = with_tables(["billing_item", "message_copies"], f""",{_VALID_EVENTS}
SELECT {U("'item:' || sku")} AS uuid, sku, '' AS name, '' AS unit
FROM (SELECT DISTINCT sku FROM valid_events) v WHERE sku NOT IN (SELECT sku FROM billing_item)""")
    out["dedup_events"] = with_tables(
        ["billing_item", "billing_event", "message_copies"],
        f""",{_VALID_EVENTS},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ingest_seq) AS rn FROM valid_events) WHERE rn = 1)
SELECT f.uuid, f.event_start, f.event_end, coalesce(i.uuid, {U("'item:' || f.sku")}) AS item_id, f."user", f.workspace, f.quantity
FROM firsts f LEFT JOIN billing_item i ON i.sku = f.sku
WHERE f.uuid NOT IN (SELECT uuid FROM billing_event WHERE event_end < {stored_before})""",
    )
    out["ingest_samples"] = with_tables(["message_copies"], f""",{_VALID_SAMPLES}
SELECT uuid, sample_time, sku, "user", workspace, rate, ingest_seq FROM valid_samples""")
    out["dedup_samples"] = with_tables(
        ["billing_item", "rate_sample", "message_copies"],
        f""",{_VALID_SAMPLES},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ingest_seq) AS rn FROM valid_samples) WHERE rn = 1)
SELECT f.uuid, f.sample_time, coalesce(i.uuid, {U("'item:' || f.sku")}) AS item_id, f."user", f.workspace, f.rate
FROM firsts f LEFT JOIN billing_item i ON i.sku = f.sku
WHERE f.uuid NOT IN (SELECT uuid FROM rate_sample WHERE sample_time < {stored_before})""",
    )
    out["workspace_map"] = with_tables(
        ["workspace_messages", "workspace_account"],
        """
SELECT workspace, account FROM (
  SELECT name AS workspace, account, row_number() OVER (PARTITION BY name ORDER BY ingest_seq) AS rn FROM workspace_messages
) WHERE rn = 1 AND workspace NOT IN (SELECT workspace FROM workspace_account)""",
    )

    # ---- access
    def vis(cond: str) -> str:
        return with_tables(
            ["billing_item", "billing_event", "workspace_account", "entitlements"],
            f"""
SELECT {_USAGE_COLS} FROM billing_event e JOIN billing_item i ON i.uuid = e.item_id WHERE {cond}""",
        )

    p = f"'{q.PRINCIPAL}'"
    out["visible_usage"] = vis(f"e.workspace IN (SELECT target FROM entitlements WHERE principal = {p} AND kind = 'workspace')")
    out["owned_usage"] = vis(
        f"e.workspace IN (SELECT target FROM entitlements WHERE principal = {p} AND kind = 'workspace' AND role = 'owner')"
    )
    out["visible_account_usage"] = vis(
        f"e.workspace IN (SELECT workspace FROM workspace_account WHERE account IN "
        f"(SELECT target FROM entitlements WHERE principal = {p} AND kind = 'account' AND role = 'owner'))"
    )
    out["admin_usage"] = vis("true")
    return out
