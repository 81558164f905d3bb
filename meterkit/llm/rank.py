"""Ranked lexical search by bag deduplication.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
One pass over all whole texts restricts each document to the vocabulary of the items: what is left
is its bag, a vector of (term, tf), besides its length n. Documents with the same vector and the
same length measure m have the same score for every item, so they form a class: rows are grouped by
a hash of (vector, m) together with the vector and m themselves, which verifies that equal hashes
are equal bags. A class is scored once for an item, and its members are expanded in ascending id.

Scores are 64-bit integers: a term's weight w is floor(1000 ln((2N+2)/(2df+1))) and a document adds
w * (10^9 tf div (1000 tf + 8 m)) for every time the item has the term, m being
100-75+((75 n N) div L). N, L and df count all documents.

How it is dealt: the items' terms are broadcast if their bytes are at most ``BROADCAST_BYTES``, else
the documents' terms meet them in a shuffle join. Classes travel in packs of one Arrow batch, items
in blocks; each pack meets each block once (a query set against all rows, in blocks) and returns its
``k`` best classes for each item, so an item's final ranking reads k rows a pack and no pair is
ever materialised. The members of a class that could be returned are its k smallest ids; they are
found in two levels, the first by input partition, so that a class with a third of all documents
reaches one task as k rows for each of ``SALTS`` parts.

Defined cases: null, empty and wordless texts have no term and are found by no item; an item
without terms, or whose terms no document has, has no row. Items that repeat an id with the same
text are one item, texts that share an id are items of their own. Documents with a repeated id are
documents of their own; a null id ranks after all others of the same score. Empty tables give an
empty result. A very long text is one bag of its distinct item terms. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, map_arrow, texts_of, written

BROADCAST_BYTES = 32 << 20
ITEM_BLOCK = 256  # items that one pack of classes is scored against at a time
SALTS = 64
PARTS = 64  # of the packs, where item blocks are too large to be broadcast
#: Every byte that is no part of a term becomes a space, A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _counted(terms: list) -> tuple[list, list[int]]:
    found: dict = {}
    for t in terms:
        found[t] = found.get(t, 0) + 1
    return list(found), list(found.values())


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of (item, text)."""

    def run(batches):
        for block in blocks(batches, "text"):
            for item, text in zip(block.column("item").to_pylist(), texts_of(block, "text")):
                terms, times = _counted(terms_of(text))
                rows = [pa.array([item] * len(terms), pa.int64()), pa.array([t.decode() for t in terms], pa.string()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["item", "term", "times"])

    return map_arrow(items, run, "item long, term string, times long")


def _bags_of_known(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of (id, text): each text's known terms by number, ascending."""
    id_type = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = shared.value
        for block in blocks(batches, "text"):
            n, size, terms, tfs = [], [0], [], []
            for text in texts_of(block, "text"):
                words = terms_of(text)
                ids, times = np.unique(np.array([number[w] for w in words if w in number], np.int64), return_counts=True)
                n.append(len(words))
                size.append(len(ids))
                terms.append(ids)
                tfs.append(times)
            at = pa.array(np.cumsum(size), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int64))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return map_arrow(docs, run, f"id {id_type}, n long, terms array<long>, tfs array<long>")


def _bags_by_join(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same where the vocabulary is too large to broadcast: terms meet it in a shuffle join."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for block in blocks(batches, "text"):
            words = [terms_of(t) for t in texts_of(block, "text")]
            counted = [_counted(w) for w in words]
            terms = pa.array([[t.decode() for t in c[0]] for c in counted], pa.list_(pa.string()))
            tfs = pa.array([c[1] for c in counted], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(list(map(len, words)), pa.int64()), terms, tfs], names=["id", "n", "terms", "tfs"])

    whole = map_arrow(docs, run, f"id {id_type}, n long, terms array<string>, tfs array<long>")
    whole = written(whole.withColumn("row", F.monotonically_increasing_id()), "rank-terms")
    each = whole.select("row", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    known = each.join(vocabulary, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "tf"))).alias("bag"))
    out = whole.select("row", "id", "n").join(known, "row", "left")
    part = lambda f, name: F.coalesce(F.col(f"bag.{f}"), F.array().cast("array<long>")).alias(name)
    return out.select("id", "n", part("number", "terms"), part("tf", "tfs"))


def bags(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, n, terms, tfs) of every document; ``vocabulary`` has (term, number)."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8).alias("n")).first().n or 0
    if size > BROADCAST_BYTES:
        return _bags_by_join(docs, vocabulary)
    return _bags_of_known(docs, {t.encode(): i for t, i in vocabulary.select("term", "number").collect()})


def classes(bag: DataFrame, k: int) -> DataFrame:
    """(m, terms, tfs, ids) of the distinct bags (columns id, m, terms, tfs) with a term: the k smallest ids."""
    key = ["hash", "m", "terms", "tfs"]
    rows = bag.where("size(terms) > 0").withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    least = F.col("id").asc_nulls_last()
    for by in ([*key, "salt"], key):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(least))
        rows = rows.withColumn("place", place).where(F.col("place") <= k)
    found = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("members"))
    return found.select("m", "terms", "tfs", F.col("members.id").alias("ids"))


def _packs(found: DataFrame, id_type: str) -> DataFrame:
    """One row per Arrow batch of classes, sorted by their smallest id; part: the batch's number."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = pc.sort_indices(pa.table({"first": pc.list_element(batch.column("ids"), 0)}), [("first", "ascending")], null_placement="at_end")
                rows = batch.take(order)
                one = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(f)) for f in rows.schema.names]
                yield pa.RecordBatch.from_arrays(one, names=rows.schema.names)

    made = map_arrow(found, run, f"m array<long>, terms array<array<long>>, tfs array<array<long>>, ids array<array<{id_type}>>")
    return made.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))


def _item_blocks(weights: DataFrame, n_blocks: int) -> DataFrame:
    """(block, postings): the items' (term, item, weight) in ``n_blocks`` blocks."""
    of = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    posting = F.struct("number", "item", "weight")
    return weights.groupBy(of.alias("block")).agg(F.sort_array(F.collect_list(posting)).alias("postings"))


def _best(k: int):
    """Of each (pack of classes, block of items): the items' k best classes."""

    def score(m, terms, tfs, size, number, item, weight):
        owner = np.repeat(np.arange(len(size)), size)
        value = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner])
        items, column = np.unique(item, return_inverse=True)
        total = np.zeros((len(items), len(size)), np.int64)
        order = np.argsort(terms, kind="stable")
        terms, owner, value = terms[order], owner[order], value[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        last = np.append(first[1:], len(terms))
        low, high = np.searchsorted(number, terms[first]), np.searchsorted(number, terms[first], side="right")
        for a, b, c, d in zip(first, last, low, high):
            if c < d:  # a class holds a term once, and so does an item
                total[np.ix_(column[c:d], owner[a:b])] += weight[c:d, None] * value[None, a:b]
        return items, total

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(f)[i].values for f in batch.schema.names}
                flat = [row["terms"].flatten().to_numpy(), row["tfs"].flatten().to_numpy()]
                size = pc.list_value_length(row["terms"]).to_numpy()
                post = [row["postings"].field(f).to_numpy() for f in ("number", "item", "weight")]
                items, total = score(row["m"].to_numpy(), *flat, size, *post)
                who, what, points = [], [], []
                for item, found in zip(items, total):
                    hit = np.flatnonzero(found > 0)
                    if len(hit) > k:  # classes stand in the order of their smallest ids
                        hit = hit[np.argsort(-found[hit], kind="stable")[:k]]
                    who.append(np.full(len(hit), item))
                    what.append(hit)
                    points.append(found[hit])
                ids = row["ids"].take(pa.array(np.concatenate(what)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(points)), ids], names=["item", "score", "ids"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, id, score): each item's ``k`` highest-scoring documents, equal scores by ascending id."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("name"), F.col(item_text).alias("text")).distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "rank-items")
    wanted = written(_item_terms(asked.select("item", "text")), "rank-item-terms")
    vocabulary = written(wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "rank-vocabulary")
    bag = written(bags(docs, vocabulary), "rank-bags")
    total = bag.agg(F.count(F.expr("if(n > 0, 1, null)")).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total.docs, max(1, total.terms)
    held = bag.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.expr(f"times * cast(floor(1000 * ln(cast({2 * n_docs + 2} as double) / (2 * df + 1))) as bigint)")
    weights = written(wanted.join(vocabulary, "term").join(held, "number").select("number", "item", weight.alias("weight")), "rank-weights")
    size = weights.agg(F.count("*").alias("rows"), F.countDistinct("item").alias("items")).first()
    n_blocks = max(1, -(-size["items"] // ITEM_BLOCK))

    measured = bag.withColumn("m", F.expr(f"100 - 75 + (75 * n * {n_docs}L) div {n_terms}L"))
    packs = _packs(classes(measured, k), id_type).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    block = _item_blocks(weights, n_blocks)
    if 24 * size["rows"] <= BROADCAST_BYTES:
        met = packs.join(F.broadcast(block), "block")
    else:
        met = packs.join(block.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["block", "part"])
    best = map_arrow(met.select("m", "terms", "tfs", "ids", "postings"), _best(k), f"item long, score long, ids array<{id_type}>")
    for first in (F.col("ids")[0], F.col("id")):  # the best classes, then the best of their members
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), first.asc_nulls_last()))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
        if "ids" in best.columns:
            best = best.select("item", "score", F.explode("ids").alias("id"))
    return best.join(asked, "item").select(F.col("name").alias(item_col), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
