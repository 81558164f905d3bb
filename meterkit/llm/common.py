"""Helpers shared by the text operators: tables, bounded Arrow blocks, written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from meterkit.session import scratch_path

BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach a Python worker small, whatever a row's length is."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did, whatever
    folder they start in. On a cluster the package is installed or sent with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


_KEPT: dict = {}  # in a Python worker: what one operator keeps between tasks


def kept_state(key: str, build):
    """What ``build`` makes, kept by this Python worker under ``key`` until another operator starts in it."""
    if key not in _KEPT:
        drop_state()
        _KEPT[key] = build()
    return _KEPT[key]


def drop_state(but: str | None = None) -> None:
    """Close and forget what this worker keeps, unless under the key ``but``, and give free memory back."""
    gone = [k for k in _KEPT if k != but]
    for key in gone:
        state = _KEPT.pop(key)
        if hasattr(state, "close"):
            state.close()
        del state
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def map_arrow(df: DataFrame, fn, schema: str, state: str | None = None) -> DataFrame:
    """``mapInArrow`` over batches of bounded size, also for column names that hold dots. A worker that
    starts ``fn`` first drops what other operators keep in it (all but ``state``): workers are used
    again, and an operator's memory must not add to the next one's."""
    bound_batches(df.sparkSession)
    importable(df.sparkSession)
    names = df.columns
    plain = any("." in n or "`" in n for n in names)

    def run(batches):
        drop_state(state)
        yield from fn((b.rename_columns(names) for b in batches) if plain else batches)

    return (df.toDF(*(f"c{i}" for i in range(len(names)))) if plain else df).mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` (texts, bytes or lists of
    longs) each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        lists = pa.types.is_list(values.type)
        length = pc.fill_null(pc.list_value_length(values) if lists else pc.binary_length(values), 0)
        size = length.to_numpy(zero_copy_only=False).astype(np.int64) * (8 if lists else 1)
        part = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            done = part[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(part, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts, null as the empty text."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(names: list[str]) -> list[str]:
    """Column names that may hold dots, for select."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def fields(df: DataFrame) -> str:
    """The schema of ``df`` as a DDL string."""
    return ", ".join(f"{q} {f.dataType.simpleString()}" for q, f in zip(quoted(df.columns), df.schema.fields))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder under the shared checkpoint folder and read again (cuts lineage)."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_table(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row of each word, id of each word, the distinct words) of lists of words."""
    import pandas as pd

    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.empty(int(counts.sum()), dtype=object)
    at = 0
    for words in rows:
        flat[at : at + len(words)] = words
        at += len(words)
    ids, distinct = pd.factorize(flat)
    return np.repeat(np.arange(len(rows)), counts), ids.astype(np.int64), list(distinct)
