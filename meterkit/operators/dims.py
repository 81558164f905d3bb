"""Joins against dimension tables (items, prices, workspace map, entitlements).

A dimension is broadcast only when its size in bytes is known to be small:

* ``small_dim(df)`` asks the planner for the size of the dimension's plan. For a stored table that
  is the size of its files, read from the file listing without running anything; joins and
  aggregates are never underestimated by it. Up to ``DIM_BYTES`` the join gets a broadcast hint, so
  the fact side is not shuffled. Above it nothing is hinted: the shuffle join stays, and adaptive
  execution may still replace it when the measured side turns out small.
* ``stored_dim(df, name)`` first writes a derived dimension to the shared folder, once, and
  then does the same with the size of the files written. A derived table whose estimate is
  far too large (a join with itself, say) gets its true size that way, and is computed once
  however often the query reads it.
* ``measured_dim(df, name)`` does so only where the planner's size is too large for a broadcast. The
  size of an aggregate is that of its input, so items derived from a fact table look as large as
  the table; left unhinted, the facts would be shuffled by the few items there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.session import scratch_path

DIM_BYTES = 8 << 20  # of Parquet files; in memory a small multiple of it


def plan_bytes(df: DataFrame) -> int:
    """The planner's size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_dim(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if plan_bytes(df) <= DIM_BYTES else df


def stored_dim(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"dim-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return small_dim(df.sparkSession.read.schema(df.schema).parquet(path))


def measured_dim(df: DataFrame, name: str) -> DataFrame:
    return F.broadcast(df) if plan_bytes(df) <= DIM_BYTES else stored_dim(df, name)
