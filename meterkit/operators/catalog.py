"""Items and prices: listing, lookup, prices in force, effective (bitemporal) price,
pricing of usage, charges, configuration upserts with replacement rules.

Price tables are small (SKUs × price changes). Pricing never shuffles the usage side:
the price list is first resolved into a non-overlapping timeline per item, then each event
finds its single piece with a range condition inside a (checked) broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterkit.functions import md5_uuid
from meterkit.operators.dims import small_dim, stored_dim

PRICE_TYPE = "decimal(38,12)"
CHARGE = "decimal(38,18)"
DIGITS, MONEY_FACTOR = "decimal(17,0)", "decimal(20,12)"  # their product is exact: 38 digits


# ------------------------------------------------------------------ C1–C4, C7


def list_items(items: DataFrame) -> DataFrame:
    """All items in SKU order."""
    return items.select("uuid", "sku", "name", "unit").orderBy("sku", "uuid")


def item_by_sku(items: DataFrame, sku: str) -> DataFrame:
    """The item with this SKU (empty when unknown; the API answers 404)."""
    return items.filter(F.col("sku") == sku).select("uuid", "sku", "name", "unit").orderBy("uuid").limit(1)


def _valid_at(prices: DataFrame, at) -> DataFrame:
    at_c = F.lit(at).cast("timestamp_ntz")
    return prices.filter(
        (F.col("valid_from") <= at_c) & (F.col("valid_until").isNull() | (F.col("valid_until") > at_c))
    )


def prices_at(prices: DataFrame, items: DataFrame, at) -> DataFrame:
    """Every price row valid at ``at`` (overlapping corrections included), with its SKU,
    ordered by (sku, valid_from)."""
    it = small_dim(items.select(F.col("uuid").alias("item_id"), "sku"))
    return (
        _valid_at(prices, at)
        .join(it, "item_id")
        .select("uuid", "sku", "item_id", "price", "valid_from", "valid_until", "configured_at")
        .orderBy("sku", "valid_from", "uuid")
    )


def _latest_configured() -> list:
    return [F.col("configured_at").desc(), F.col("valid_from").desc(), F.col("uuid").asc()]


def effective_prices(prices: DataFrame, items: DataFrame, at, known_at=None) -> DataFrame:
    """The price in force at ``at`` per item: among valid rows the latest
    ``configured_at`` wins. With ``known_at`` only rows configured by then count (the price
    list as presented at that time)."""
    p = _valid_at(prices, at)
    if known_at is not None:
        p = p.filter(F.col("configured_at") <= F.lit(known_at).cast("timestamp_ntz"))
    w = Window.partitionBy("item_id").orderBy(*_latest_configured())
    best = p.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    it = small_dim(items.select(F.col("uuid").alias("item_id"), "sku"))
    return best.join(it, "item_id").select("uuid", "sku", "item_id", "price", "valid_from", "valid_until", "configured_at")


def record_prices(history: DataFrame, prices: DataFrame, at) -> DataFrame:
    """The price history after the list became ``prices`` at ``at``: a row that was changed or
    closed by the load keeps its old state with ``known_until``, its new state is added."""
    columns = prices.columns
    when = F.lit(at).cast("timestamp_ntz")
    opened = history.filter(F.col("known_until").isNull())
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}")) for c in columns]
    unlike = lambda how: opened.alias("h").join(prices.alias("p"), same, how)
    closed = unlike("left_anti").withColumn("known_until", when)
    added = prices.alias("p").join(opened.alias("h"), same, "left_anti").select(*columns, when.alias("known_from"), F.lit(None).cast("timestamp_ntz").alias("known_until"))
    return history.filter(F.col("known_until").isNotNull()).unionByName(closed).unionByName(unlike("left_semi")).unionByName(added)


def prices_known(history: DataFrame, known_at) -> DataFrame:
    """The price list as it stood at ``known_at``, overwritten and closed rows as they were then."""
    at = F.lit(known_at).cast("timestamp_ntz")
    rows = history.filter((F.col("known_from") <= at) & (F.col("known_until").isNull() | (F.col("known_until") > at)))
    return rows.drop("known_from", "known_until")


def price_violations(prices: DataFrame) -> DataFrame:
    """V4: price rows that break the range rule (``valid_until`` is NULL or not before
    ``valid_from``)."""
    return prices.filter(F.col("valid_until").isNotNull() & (F.col("valid_until") < F.col("valid_from")))


# ------------------------------------------------------------------ C5, C6


def price_timeline(prices: DataFrame) -> DataFrame:
    """Resolve overlapping price rows into pieces [piece_start, piece_end) per item with the
    winning row (latest ``configured_at``, then latest ``valid_from``). ``piece_end`` NULL =
    open. Runs on the price table only.

    A price is not paired with every piece it covers. The pieces of an item are numbered, and a price
    lands on the nodes of the dyadic cover of its range of pieces (aligned runs of 2^level pieces, two
    a level at most); a node keeps its best price, and a piece takes the best over the nodes that
    contain it. So P overlapping prices of one item make P log P rows, not P squared."""
    ends = F.explode(F.array("valid_from", "valid_until")).alias("p")
    bounds = prices.select("item_id", ends).filter(F.col("p").isNotNull()).distinct()
    w = Window.partitionBy("item_id").orderBy("p")
    number = F.row_number().over(w).cast("long") - 1
    pieces = bounds.select("item_id", F.col("p").alias("piece_start"), F.lead("p").over(w).alias("piece_end"), number.alias("i"))
    span = pieces.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    at = pieces.select("item_id", F.col("piece_start").alias("p"), "i")
    first = at.withColumnsRenamed({"p": "valid_from", "i": "a"})
    last = at.withColumnsRenamed({"p": "valid_until", "i": "b"})
    ranged = prices.join(first, ["item_id", "valid_from"]).join(last, ["item_id", "valid_until"], "left").join(span, "item_id")
    ranged = ranged.withColumn("b", F.coalesce("b", "n"))
    # in units of 2^level pieces the range is [low, high): an odd low and the one before an odd high are in no larger node
    low, high = "shiftright(a + shiftleft(1L, level) - 1, level)", "shiftright(b, level)"
    ends_of = f"array(if({low} < {high} and {low} % 2 = 1, {low}, null), if({low} < {high} and {high} % 2 = 1, {high} - 1, null))"
    cover = f"flatten(transform(sequence(0, length(bin(n))), level -> transform(filter({ends_of}, x -> x is not null), x -> struct(level as level, x as node))))"
    nodes = ranged.select("item_id", "uuid", "price", "configured_at", "valid_from", F.expr(f"inline({cover})"))
    above = pieces.join(span, "item_id").select("item_id", "piece_start", "piece_end", F.expr("inline(transform(sequence(0, length(bin(n))), level -> struct(level as level, shiftright(i, level) as node)))"))
    best = _best(nodes, "item_id", "level", "node")
    return _best(above.join(best, ["item_id", "level", "node"]), "item_id", "piece_start").select("item_id", "piece_start", "piece_end", F.col("uuid").alias("price_id"), "price")


def _best(rows: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_latest_configured())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def exact_charge(quantity: Column, price: Column) -> Column:
    """``quantity`` (a double, taken as the decimal number it prints as) times ``price``, exact, then
    rounded once to 18 places; NULL where it does not fit ``CHARGE`` or the price is 10^8 or more.

    The double's digits (17 at most) and the price are multiplied as decimals and the power of ten is put back
    by the cast from text, so neither 10^13 byte-seconds nor a price of 10^-12 is rounded on the way."""
    text = quantity.cast("string")
    digits = F.split_part(text, F.lit("E"), F.lit(1))
    power = F.coalesce(F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0))
    places = F.length(digits) - F.instr(digits, ".")
    whole = F.replace(digits, F.lit("."), F.lit("")).try_cast(DIGITS) * price.try_cast(MONEY_FACTOR)
    return F.concat(whole.cast("string"), F.lit("E"), (power - places).cast("string")).try_cast(CHARGE)


def price_usage(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Each event priced at its start with the effective price then. ``charge`` is the exact product
    (``exact_charge``), so sums do not depend on order and rounding is left to the output. Where it is
    NULL, ``charge_reason`` says why: ``no_price`` or ``out_of_range``."""
    tl = stored_dim(price_timeline(prices), "price-timeline")
    cond = (
        (events["item_id"] == tl["item_id"])
        & (tl["piece_start"] <= events["event_start"])
        & (tl["piece_end"].isNull() | (events["event_start"] < tl["piece_end"]))
    )
    j = events.join(tl, cond, "left")
    priced = j.select(
        events["uuid"],
        events["event_start"],
        events["event_end"],
        events["item_id"],
        events["workspace"],
        events["quantity"],
        tl["price_id"],
        tl["price"],
        exact_charge(events["quantity"], tl["price"]).alias("charge"),
    )
    reason = F.when(F.col("price_id").isNull(), F.lit("no_price")).when(F.col("charge").isNull(), F.lit("out_of_range"))
    return priced.withColumn("charge_reason", reason)


def account_charges(priced: DataFrame, accounts: DataFrame) -> DataFrame:
    """Charges per account and UTC month; workspaces without an account stand under a NULL account.
    ``uncharged`` counts the events without a charge (see ``charge_reason``).

    Charges are first summed per (workspace, month), map-side combined, so the join to the
    workspace map sees one row per workspace-month however many events a workspace has."""
    month = F.trunc(F.col("event_start").cast("date"), "month").cast("timestamp_ntz")
    per_ws = priced.groupBy("workspace", month.alias("month")).agg(
        F.sum("charge").alias("charge"), F.count(F.lit(1)).alias("events"), F.count("charge_reason").alias("uncharged")
    )
    return (
        per_ws.join(accounts.select("workspace", "account"), "workspace", "left")
        .groupBy("account", "month")
        .agg(F.sum("charge").alias("charge"), F.sum("events").alias("events"), F.sum("uncharged").alias("uncharged"))
    )


# ------------------------------------------------------------------ D4, D5


def upsert_items(items: DataFrame, config_items: DataFrame) -> DataFrame:
    """By SKU, update only the fields present (non-NULL) in the config, else insert.
    A new item needs sku, name and unit; its uuid is derived from the SKU.

    A SKU that the config names more than once is one item: the last non-NULL value of each
    field counts, in document order (``seq``; without it the largest value)."""
    at = F.col("seq") if "seq" in config_items.columns else F.lit(0)

    def last(field: str) -> Column:
        return F.max(F.when(F.col(field).isNotNull(), F.struct(at.alias("at"), F.col(field).alias("value"))))["value"]

    new = config_items.where(F.col("sku").isNotNull()).groupBy("sku").agg(last("name").alias("new_name"), last("unit").alias("new_unit"))
    j = items.join(new, "sku", "full_outer")
    inserted = F.col("uuid").isNull()
    return j.filter(~inserted | (F.col("new_name").isNotNull() & F.col("new_unit").isNotNull())).select(
        F.coalesce(F.col("uuid"), md5_uuid(F.concat(F.lit("item:"), F.col("sku")))).alias("uuid"),
        "sku",
        F.coalesce("new_name", "name").alias("name"),
        F.coalesce("new_unit", "unit").alias("unit"),
    )


def _checked_price_config(prices: DataFrame, items: DataFrame, config: DataFrame) -> DataFrame:
    """Config rows (sku, valid_from, price, seq) with item, and the reject reason if any."""
    it = items.select(F.col("uuid").alias("item_id"), "sku")
    c = config.join(it, "sku", "left")
    latest = prices.groupBy("item_id").agg(F.max("valid_from").alias("emax"))
    existing = prices.select(F.col("item_id").alias("_ei"), F.col("valid_from").alias("_ev")).distinct()
    c = c.join(latest, "item_id", "left")
    c = (
        c.join(existing, (F.col("item_id") == F.col("_ei")) & (F.col("valid_from") == F.col("_ev")), "left")
        .withColumn("old", F.col("_ei").isNotNull())
        .drop("_ei", "_ev")
    )
    before = Window.partitionBy("sku").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same_before = Window.partitionBy("sku", "valid_from").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("pm", F.greatest(F.col("emax"), F.max("valid_from").over(before))).withColumn(
        "seen", F.count(F.lit(1)).over(same_before) > 0
    )
    reason = (
        F.when(F.col("item_id").isNull(), F.lit("unknown_sku"))
        .when(F.col("valid_from").isNull() | F.col("price").isNull(), F.lit("missing_field"))
        .when(
            ~F.col("old") & ~F.col("seen") & F.col("pm").isNotNull() & (F.col("valid_from") < F.col("pm")),
            F.lit("valid_from_before_latest"),
        )
    )
    return c.withColumn("reason", reason)


def price_rejects(prices: DataFrame, items: DataFrame, config: DataFrame) -> DataFrame:
    """Config rows that abort the load (unknown SKU, or a new valid_from earlier than
    the latest price at that point of the load)."""
    return (
        _checked_price_config(prices, items, config)
        .filter(F.col("reason").isNotNull())
        .select("seq", "sku", "valid_from", "price", "reason")
    )


def upsert_prices(prices: DataFrame, items: DataFrame, config: DataFrame, configured_at) -> DataFrame:
    """D5a/D5b as one set operation (config rows applied in ``seq`` order).

    An exact (item, valid_from) match overwrites the price of every matching row (the last
    config row wins); a new valid_from is appended and the rows before it are closed:
    ``valid_until`` becomes the next valid_from for every row whose successor is new. If any
    row is rejected, use ``apply_price_config``, which then keeps the table unchanged.
    """
    checked = _checked_price_config(prices, items, config)
    ok = checked.filter(F.col("reason").isNull())
    last = ok.groupBy("item_id", "valid_from").agg(F.max_by("price", "seq").alias("new_price"))

    updated = prices.join(last, ["item_id", "valid_from"], "left").select(
        "uuid",
        "item_id",
        F.coalesce(F.col("new_price").cast(PRICE_TYPE), F.col("price")).alias("price"),
        "valid_from",
        "valid_until",
        "configured_at",
        F.lit(False).alias("is_new"),
    )
    added = last.join(prices.select("item_id", "valid_from").distinct(), ["item_id", "valid_from"], "left_anti").select(
        md5_uuid(F.concat(F.lit("price:"), F.col("item_id"), F.lit(":"), F.col("valid_from").cast("string"))).alias("uuid"),
        "item_id",
        F.col("new_price").cast(PRICE_TYPE).alias("price"),
        "valid_from",
        F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        F.lit(configured_at).cast("timestamp_ntz").alias("configured_at"),
        F.lit(True).alias("is_new"),
    )
    allp = updated.unionByName(added)
    # successor per row: next distinct valid_from of the item; among rows tied on the old
    # latest valid_from only the latest configured one is closed
    nxt = (
        allp.select("item_id", "valid_from", "is_new")
        .distinct()
        .withColumn("next_from", F.lead("valid_from").over(Window.partitionBy("item_id").orderBy("valid_from")))
        .withColumn("next_is_new", F.lead("is_new").over(Window.partitionBy("item_id").orderBy("valid_from")))
        .select("item_id", "valid_from", "next_from", "next_is_new")
    )
    tie = Window.partitionBy("item_id", "valid_from").orderBy(*_latest_configured())
    result = (
        allp.join(nxt, ["item_id", "valid_from"], "left")
        .withColumn("_rank", F.row_number().over(tie))
        .withColumn(
            "valid_until",
            F.when(F.coalesce(F.col("next_is_new"), F.lit(False)) & ((F.col("_rank") == 1) | F.col("is_new")), F.col("next_from")).otherwise(
                F.col("valid_until")
            ),
        )
        .select("uuid", "item_id", "price", "valid_from", "valid_until", "configured_at")
    )
    return result


def apply_price_config(prices: DataFrame, items: DataFrame, config: DataFrame, configured_at) -> tuple[DataFrame, DataFrame]:
    """D5 load: (new price table, rejects). Any reject aborts the whole load, so the table is
    returned unchanged then. The abort decision is one bounded driver check (first reject)."""
    rejects = price_rejects(prices, items, config)
    if rejects.limit(1).count() > 0:
        return prices, rejects
    return upsert_prices(prices, items, config, configured_at), rejects
