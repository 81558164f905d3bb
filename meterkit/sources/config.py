"""The items/prices configuration document.

The document is JSON (one document per file, ``multiLine``) with optional ``items`` and
``prices`` arrays; a missing section is empty, a missing file is reported and skipped,
a document that is not an object is an error. Config rows are numbered in document order
(``seq``) because price rows are applied in that order.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from meterkit import schemas
from meterkit.functions import parse_ts
from meterkit.operators import catalog

log = logging.getLogger(__name__)


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(config items, config prices) or None when the file does not exist. A document that
    is not a JSON object is an error."""
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.first()
    except AnalysisException:
        log.warning("configuration file %s not found; continuing without it", path)
        return None
    checked = raw.select(
        F.when(F.trim(F.col("value")).startswith("{"), F.col("value")).alias("value")
    )
    if checked.filter(F.col("value").isNull()).limit(1).count() > 0:
        raise ValueError(f"configuration {path} is not a JSON object - check the format")
    # a document that breaks off or is no JSON leaves its text in the corrupt-record column
    schema = StructType([*schemas.CONFIG.fields, StructField("_corrupt", StringType(), True)])
    doc = checked.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("d")).select("d.*")
    if doc.filter(F.col("_corrupt").isNotNull()).limit(1).count() > 0:
        raise ValueError(f"configuration {path} is broken JSON")
    return config_frames(doc.drop("_corrupt"))


def config_frames(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = doc.select(F.posexplode(F.coalesce("items", F.array())).alias("seq", "i")).filter(F.col("i").isNotNull())
    items = items.select(F.col("seq").cast("long").alias("seq"), "i.sku", "i.name", "i.unit")
    prices = doc.select(F.posexplode(F.coalesce("prices", F.array())).alias("pos", "p"))
    prices = prices.select(
        F.col("pos").cast("long").alias("seq"),
        F.col("p.sku").alias("sku"),
        parse_ts(F.col("p.valid_from")).alias("valid_from"),
        F.col("p.price").cast(schemas.PRICE).alias("price"),
    )
    return items, prices


def apply_config(store, items_cfg: DataFrame, prices_cfg: DataFrame, configured_at) -> DataFrame:
    """Items first, then prices and their history, in one commit; nothing is written when any
    price row is rejected. Returns the rejects (empty when the load was applied)."""

    def body(tx) -> DataFrame:
        items = catalog.upsert_items(tx.read("billing_item"), items_cfg)
        table, rejects = catalog.apply_price_config(tx.read("billing_item_price"), items, prices_cfg, configured_at)
        rejects = store.spark.createDataFrame(rejects.collect(), rejects.schema)  # at most the configuration's rows
        if rejects.isEmpty():
            tx.replace("billing_item", items)
            tx.replace("billing_item_price", table)
            tx.replace("price_history", catalog.record_prices(tx.read("price_history"), table, configured_at))
        return rejects

    return store.run(body)
