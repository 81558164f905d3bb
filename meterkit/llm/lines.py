"""Exact removal of repeated passages by hashing lines and their sentences.

A text is cut into units after line ends and after sentence marks. A unit is normalised (A-Z to
lower case, white space between words to one space) and digested (128 bits). Digests are grouped
over the whole corpus and the earliest occurrence stays, by the order of (id, text hash, place in
the text), nulls last. Later occurrences that stand next to each other form a run, and a run of at
least ``MIN_WORDS`` words is removed; shorter ones (a common short line, say) stay. Offsets of what is
removed refer to the original text in code points, the end exclusive.

Occurrences inside one block of documents are compared before the shuffle: only the block's
earliest one goes on under its digest, so a line in a third of all documents reaches its
task as one row per block. The others are known to be later ones.

Defined cases: null and empty texts have no units (a null text stays null). Units without a word
belong to no run but are removed when they stand inside one. Rows that repeat an id with the same
text are one occurrence and get equal results. An empty table gives an empty result. A very long text
is cut into its units whole. All columns are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, fields, fresh, map_arrow, mix64, texts_of, written

MIN_WORDS = 25
BROADCAST_BYTES = 32 << 20
#: A unit with the marks that end it; together the units are the whole text.
UNIT = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
_UNITS = re.compile(UNIT)


def units(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised unit, words) of the units that have a word."""
    out, at = [], 0
    for unit in _UNITS.findall(text):
        words = unit.encode().lower().split()
        if words:
            out.append((at, at + len(unit), b" ".join(words), len(words)))
        at += len(unit)
    return out


_FIELDS = ["d1", "d2", "id", "hash", "place", "start", "end", "words", "later"]


def _unit_rows(batches):
    for block in blocks(batches, "text"):
        found = [units(t) for t in texts_of(block, "text")]
        count = np.array([len(f) for f in found])
        total = int(count.sum())
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u[2]) for f in found for u in f), np.int64).reshape(total, 2)
        number = lambda k: np.fromiter((u[k] for f in found for u in f), np.int64, total)
        row = np.repeat(np.arange(len(found)), count)
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        order = pc.sort_indices(pa.table({"id": block.column("id"), "hash": block.column("hash")}), [("id", "ascending"), ("hash", "ascending")], null_placement="at_end")
        rank = np.empty(len(found), np.int64)
        rank[order.to_numpy()] = np.arange(len(found))
        by = np.lexsort((place, rank[row], digest[:, 1], digest[:, 0]))
        d = digest[by]
        later = np.zeros(total, bool)
        later[by[1:]] = (d[1:] == d[:-1]).all(axis=1)
        # rows with the same id and text are one occurrence: their first units are all earliest
        same = _same_rows(block, order.to_numpy())
        if same is not None:
            first = same[row]
            lead = np.flatnonzero(np.append(True, (d[1:] != d[:-1]).any(axis=1))) if total else np.zeros(0, np.int64)
            head = np.repeat(by[lead], np.diff(np.append(lead, total)))
            later[by] &= (first[by] != first[head]) | (place[by] != place[head])
        spread = mix64(digest[:, 0].view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)).view(np.int64)
        d1, d2 = np.where(later, spread, digest[:, 0]), digest[:, 1]
        take = pa.array(row)
        cols = [pa.array(d1), pa.array(d2), block.column("id").take(take), block.column("hash").take(take), pa.array(place), pa.array(number(0)), pa.array(number(1)), pa.array(number(3)), pa.array(later)]
        yield pa.RecordBatch.from_arrays(cols, names=_FIELDS)


def _same_rows(block: pa.RecordBatch, order: np.ndarray):
    """For each row the first (in order) with the same id and text hash, or None if all differ."""
    ids, hashes = block.column("id").take(pa.array(order)).to_pylist(), block.column("hash").to_numpy()[order]
    lead = np.arange(len(order))
    for i in range(1, len(order)):
        if hashes[i] == hashes[i - 1] and ids[i] == ids[i - 1]:
            lead[i] = lead[i - 1]
    if (lead == np.arange(len(order))).all():
        return None
    out = np.empty(len(order), np.int64)
    out[order] = order[lead]
    return out


def _later_rows(batches):
    """From rows sorted by digest and rank: those that are not their digest's earliest occurrence."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        d1, d2, later = batch.column("d1").to_numpy(), batch.column("d2").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False)
        hashes, place = batch.column("hash").to_numpy(), batch.column("place").to_numpy()
        ids = batch.column("id")
        opens = np.ones(n, bool)
        opens[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        follows = ~opens
        if last is not None and (d1[0], d2[0]) == last[:2]:
            follows[head == 0] = True
        # the same row of the corpus twice is one occurrence
        for i in np.flatnonzero(follows & ~later):
            h = (ids[int(head[i])].as_py(), hashes[head[i]], place[head[i]]) if not (head[i] == 0 and last is not None and (d1[0], d2[0]) == last[:2]) else last[2:]
            if hashes[i] == h[1] and place[i] == h[2] and ids[int(i)].as_py() == h[0]:
                follows[i] = False
        k = int(head[-1])
        if not (k == 0 and last is not None and (d1[0], d2[0]) == last[:2]):
            last = (d1[-1], d2[-1], ids[k].as_py(), hashes[k], place[k])
        yield batch.filter(pa.array(follows | later)).select(["id", "hash", "place", "start", "end", "words"])


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, removed): per text the runs of later occurrences as (start, end, units), in order."""
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    rest = "place long, start long, end long, words long"
    rows = map_arrow(source, _unit_rows, f"d1 long, d2 long, id {id_type}, hash long, {rest}, later boolean")
    rows = rows.repartition("d1").sortWithinPartitions("d1", "d2", F.col("id").asc_nulls_last(), "hash", "place")
    later = map_arrow(rows, _later_rows, f"id {id_type}, hash long, {rest}").dropDuplicates(["id", "hash", "place"])
    near = F.col("place") - F.row_number().over(Window.partitionBy("id", "hash").orderBy("place"))
    run = later.withColumn("run", near).groupBy("id", "hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.count("*").alias("units"))
    run = run.where(F.col("words") >= min_words)
    return run.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "units"))).alias("removed"))


def without(text: str | None, removed: list[dict] | None) -> str | None:
    if text is None or not removed:
        return text
    out, at = [], 0
    for span in removed:
        out.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*out, text[at:]])


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with repeated passages taken out of its text, and ``removed``: their (start, end, units)
    in the original text (a column of that name is replaced)."""
    df = df.drop("removed")
    key, tag = fresh(df, "__id"), fresh(df, "__hash")
    runs = written(repeated_runs(df, id_col, text_col, min_words), "removed").select(F.col("id").alias(key), F.col("hash").alias(tag), "removed")
    size = runs.agg(F.coalesce(F.sum(F.size("removed") * 24 + 24), F.lit(0)).alias("n")).first().n
    runs = F.broadcast(runs) if size <= BROADCAST_BYTES else runs
    both = df.join(runs, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(tag)), "left").drop(key, tag)
    place = both.columns.index(text_col)

    def run(batches):
        for block in blocks(batches, text_col):
            kept = [without(t, r) for t, r in zip(block.column(text_col).to_pylist(), block.column("removed").to_pylist())]
            yield block.set_column(place, text_col, pa.array(kept, pa.string()))

    return map_arrow(both, run, fields(both))
