"""Document fingerprints by spot signatures.

A spot is a common word (``ANCHORS``); its signature is that word with the chain of the next
``CHAIN`` content words (words that are no anchor). So that texts without common words have
signatures too, a content word whose digest begins with the hexadecimal digit 0 is a spot as well (one
word in sixteen, the same in every text), and the text's start is one, followed by its first
``CHAIN`` words of any kind. The fingerprint is the set of the signatures' 64-bit digests, written in
hexadecimal, sorted and joined.

Two fingerprints are compared by the Jaccard coefficient of their sets, pruned by set length: sets
fall into partitions by their size, and sizes that are further apart than the asked least likeness
allows are not merged; a merge ends once the elements left cannot reach it. With a least likeness of
0, as in ``edited_likeness``, every value is exact. ``compare`` does this for a table of pairs: sizes
first, and only the pairs whose partitions meet fetch their fingerprints.

``edited_likeness`` pairs every document with the next by descending id without a global window.
Parts of the id range are bounded by keys (id, text hash) that exist; a part's first row is also sent
to the part before it, so each part knows the row after its last one, and the very first row to the
last part. Equal rows of a block travel as one row with their number. Texts are shuffled once.

Defined cases: null texts are empty; a text without words has an empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0. Ids in descending order, null last; rows
that share an id stand by descending hash of the text; equal rows are neighbours and each is a
document with its own row. The one row of a table is its own next document. An empty table gives an
empty result. Long texts are fingerprinted whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, map_arrow, texts_of
from meterkit.llm.rank import terms_of

CHAIN = 2
DIGITS = 16
# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    b"a an and is of the to was "
    b"das der die ein eine ist und von "
    b"de des est et la le les un une "
    b"el es las los una y".split()
)
_START = b"^"
CACHE_WORDS = 200_000
PART_ROWS = 2048
KEYS_PER_PART = 20


class Spots:
    """Signatures of texts; remembers which words are anchors or spots."""

    def __init__(self):
        self.kind: dict[bytes, int] = {}  # 0 content, 1 anchor, 2 content that is a spot

    def _kind(self, word: bytes) -> int:
        if len(self.kind) > CACHE_WORDS:
            self.kind.clear()
        kind = 1 if word in ANCHORS else 2 if hashlib.md5(word).hexdigest()[0] == "0" else 0
        self.kind[word] = kind
        return kind

    def signatures(self, text: str) -> list[str]:
        """The sorted digests of the text's signatures."""
        words = terms_of(text)
        if not words:
            return []
        content: list[bytes] = []
        spots: list[tuple[bytes, int]] = []
        known = self.kind.get
        for w in words:
            kind = known(w)
            if kind is None:
                kind = self._kind(w)
            if kind != 1:
                content.append(w)
            if kind:
                spots.append((w, len(content)))
        found = {b":".join((w, *content[at : at + CHAIN])) for w, at in spots if at < len(content)}
        found.add(b":".join((_START, *words[:CHAIN])))
        return sorted({hashlib.md5(s).hexdigest()[:DIGITS] for s in found})


def partition(size: int, least: float) -> int:
    """The length partition of a set: sets at least ``least`` alike lie in one or in neighbours."""
    n, low = 0, 1
    while size > low:
        low = max(low + 1, int(low / least))
        n += 1
    return n


def likeness(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Jaccard coefficient of two sorted lists without repeats; 0 where it is below ``least``."""
    if not a or not b:
        return float(not a and not b)
    if least > 0 and abs(partition(len(a), least) - partition(len(b), least)) > 1:
        return 0.0
    if least <= 0:
        both = len(set(a).intersection(b))
        return both / (len(a) + len(b) - both)
    need = least * (len(a) + len(b)) / (1 + least) - 1e-9  # elements to share
    i = j = both = 0
    while i < len(a) and j < len(b):
        if both + min(len(a) - i, len(b) - j) < need:
            return 0.0
        if a[i] == b[j]:
            both, i, j = both + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    value = both / (len(a) + len(b) - both)
    return value if value >= least else 0.0


def parts_of(fingerprint: str) -> list[str]:
    return [fingerprint[i : i + DIGITS] for i in range(0, len(fingerprint), DIGITS)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_signatures, fingerprint) of every row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        spots = Spots()
        for block in blocks(batches, "text"):
            found = [spots.signatures(t) for t in texts_of(block, "text")]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(list(map(len, found)), pa.int64()), pa.array(["".join(f) for f in found], pa.string())], names=["id", "n_signatures", "fingerprint"])

    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {id_type}, n_signatures long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def compare(prints: DataFrame, pairs: DataFrame, least: float, id_col: str = "doc_id") -> DataFrame:
    """``pairs`` (a, b: ids) with their likeness; 0 where it is below ``least`` (above 0). ``prints`` has one row per id."""
    size = prints.select(F.col(id_col).alias("id"), "n_signatures")
    whole = prints.select(F.col(id_col).alias("id"), "fingerprint")
    sized = pairs.select("a", "b")
    for side in "ab":
        sized = sized.join(size.withColumnsRenamed({"id": side, "n_signatures": f"n{side}"}), side)
    met = sized.where(F.expr(f"least(na, nb) >= {least!r} * greatest(na, nb)"))
    for side in "ab":
        met = met.join(whole.withColumnsRenamed({"id": side, "fingerprint": f"f{side}"}), side)

    def run(batches):
        for block in blocks(batches, "fa"):
            both = zip(block.column("fa").to_pylist(), block.column("fb").to_pylist())
            found = [likeness(parts_of(x), parts_of(y), least) for x, y in both]
            yield pa.RecordBatch.from_arrays([block.column("a"), block.column("b"), pa.array(found, pa.float64())], names=["a", "b", "likeness"])

    kind = [pairs.schema[c].dataType.simpleString() for c in "ab"]
    near = map_arrow(met.select("a", "b", "fa", "fb"), run, f"a {kind[0]}, b {kind[1]}, likeness double")
    return near.unionByName(sized.where(f"least(na, nb) < {least!r} * greatest(na, nb)").select("a", "b", F.lit(0.0).alias("likeness")))


def _key(id_, hash_):
    """Ascending order of the keys; documents follow each other in descending order."""
    return (id_ is not None, id_, hash_)


def _bounds(source: DataFrame) -> list[tuple]:
    """Ascending keys that bound the parts, the largest key among them: one for about PART_ROWS rows,
    from a sample of the keys that only decides how rows are dealt; at most 4 for each shuffle partition."""
    order = [F.col("id").desc_nulls_last(), F.col("hash").desc()]
    keys = source.select("id", "hash")
    top = keys.orderBy(*order).limit(1).collect()
    parts = min(4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count() // PART_ROWS)
    if parts < 2:
        return [_key(*r) for r in top]
    some = keys.sample(min(1.0, KEYS_PER_PART * parts / max(1, keys.count())), 7).collect()
    some = sorted(_key(*r) for r in some)
    return sorted({*some[:: max(1, len(some) // parts)], *(_key(*r) for r in top)})


def _dealt(bounds: list[tuple]):
    """Rows with their part; a part's first row also as an extra row of the part before it."""

    def run(batches):
        for block in blocks(batches, "text"):
            rows: dict = {}
            for id_, hash_, text in zip(block.column("id").to_pylist(), block.column("hash").to_pylist(), texts_of(block, "text")):
                rows[id_, hash_, text] = rows.get((id_, hash_, text), 0) + 1
            out = []
            for (id_, hash_, text), copies in rows.items():
                part = bisect_left(bounds, _key(id_, hash_))
                out.append((part, False, id_, hash_, text, copies))
                if bounds[part] == _key(id_, hash_):
                    out.append(((part + 1) % len(bounds), True, id_, hash_, text, copies))
            kinds = [pa.int64(), pa.bool_(), block.column("id").type, pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "extra", "id", "hash", "text", "copies"])

    return run


_RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "copies"]


def _in_order(batches):
    """From rows sorted by part, extra and descending key: the result of each row and the row after it."""
    spots = Spots()
    last, out, size = None, [], 0

    def result(row, text, after, copies):
        k = len(row["text"]) // 3
        edited = row["text"][: len(row["text"]) - k] + text[:k]
        found = spots.signatures(edited)
        own = row["found"]
        return (row["id"], len(row["text"]), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(found), likeness(own, found), likeness(own, after), len(own), copies)

    def made(id_type):
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_RESULT)

    id_type = None
    for batch in batches:
        id_type = batch.column("id").type
        for row in batch.to_pylist():
            same = last is not None and last["part"] == row["part"]
            if same and (last["extra"] or (not row["extra"] and row["id"] == last["id"] and row["text"] == last["text"])):
                last["copies"] += row["copies"]
                continue
            row["found"] = spots.signatures(row["text"])
            if same:
                out.append(result(last, row["text"], row["found"], 1))
                if last["copies"] > 1:
                    out.append(result(last, last["text"], last["found"], last["copies"] - 1))
                size += len(last["text"])
            last = row
            if size > 1 << 20:
                yield made(id_type)
                out, size = [], 0
    if out:
        yield made(id_type)


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_signatures. The edited text has the last third of its code points (rounded down) replaced by the
    first as many of the next document by descending id, or by all of that one."""
    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    rows = map_arrow(source, _dealt(_bounds(source)), f"part long, extra boolean, id {id_type}, hash long, text string, copies long")
    rows = rows.repartition("part").sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), F.col("hash").desc())
    kinds = [id_type, "long", "string", "string", "string", "double", "double", "long", "long"]
    made = map_arrow(rows, _in_order, ", ".join(f"{n} {k}" for n, k in zip(_RESULT, kinds)))
    each = made.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return each.select(F.col("id").alias(id_col), *_RESULT[1:-1])
