"""Benchmark decontamination by suffix arrays over training shards.

A shard is a block of whole documents inside a task. Words become ids of the benchmark's
vocabulary; a stretch of documents that could hold a benchmark window consists of known words
only, so the shard's suffix array is built (by prefix doubling) over exactly those stretches that
are at least as long as the shortest window. Every test suffix is then binary-searched in it: the
neighbours of its place give its longest verbatim match, the range that shares its first
``WINDOW`` words gives the places where that window occurs.

The benchmark reaches the tasks in broadcast blocks of at most ``BENCH_BYTES`` of text, read one
block at a time from an iterator, so neither the driver nor a worker holds more than one; each
shard is searched for every block and the hits are united.

Defined cases: null and empty texts have no words and no hits; null or empty items have no window.
An item of fewer words than WINDOW is one window. Repeated rows of an item count once by its
item_id; a row without item_id marks its words but is not listed. Documents are judged one by one,
so repeated rows get equal results, a null id stays null, empty tables give an empty result or no
hit. Columns besides the named ones are ignored (``decontaminate`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterkit.llm.common import blocks, fields, map_arrow

WINDOW = 13
MIN_SHARE = 20  # contaminated: MIN_SHARE * hit words >= words
BENCH_BYTES = 4 << 20
SHARD_BYTES = 4 << 20

# bytes that are no part of a word become spaces; A-Z were lower-cased before
_SEPARATE = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode().lower().translate(_SEPARATE).split() if text else []


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", limit: int = BENCH_BYTES) -> list:
    """Broadcast variables, each a list of (item id as text or None, text) of bounded size."""
    sc = benchmark.sparkSession.sparkContext
    out, part, size = [], [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        if not text:
            continue
        if part and size + len(text) > limit:
            out.append(sc.broadcast(part))
            part, size = [], 0
        part.append((None if item is None else str(item), text))
        size += len(text)
    if part:
        out.append(sc.broadcast(part))
    return out


class TestSuffixes:
    """The suffixes of a block of benchmark items, as word ids."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        split = [(item, words(text)) for item, text in items]
        split = [(item, w) for item, w in split if w]
        self.vocab: dict[bytes, int] = {}
        for _, w in split:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.items = [item for item, _ in split]
        size = np.array([len(w) for _, w in split], np.int64)
        self.longest = int(size.max(initial=0))
        # every item ends in -1, which equals no word
        self.tokens = np.array([t for _, w in split for t in [*(self.vocab[x] for x in w), -1]] + [-1], np.int64)
        start = np.cumsum(size + 1) - size - 1
        self.item = np.repeat(np.arange(len(split)), size)
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.suffix = np.repeat(start, size) + offset
        self.offset, self.length = offset, np.repeat(size, size) - offset
        self.window = np.minimum(window, np.repeat(size, size))
        self.is_window = self.length >= self.window
        self.shortest = int(self.window.min(initial=window))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the positive tokens, sorted by the words that follow them up to ``depth`` (0 ends a stretch)."""
    at = np.flatnonzero(tokens)
    rank = tokens.copy()
    k = 1
    while True:
        follow = np.zeros_like(rank)
        follow[: len(rank) - k] = rank[k:] if k < len(rank) else 0
        key = rank[at] * (int(rank.max(initial=0)) + 1) + follow[at]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(at) else np.zeros(0, np.int64)
        k *= 2
        if k >= depth or not len(at) or new[-1] == len(at):
            return at[order]
        rank = np.zeros_like(rank)
        rank[at[order]] = new


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of a[i:] and b[j:], at most ``most``, for each pair."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        live = live[a[i[live] + out[live]] == b[j[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def _search(tests: TestSuffixes, tokens: np.ndarray, order: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every test suffix cut to ``depth`` words: how many shard suffixes come
    before it (after=True: or start with it)."""
    lo, hi = np.zeros(len(tests.suffix), np.int64), np.full(len(tests.suffix), len(order), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        s, q = order[mid], tests.suffix[live]
        same = _common(tests.tokens, q, tokens, s, depth[live])
        whole = same == depth[live]
        before = np.where(whole, after, tokens[s + same] < tests.tokens[np.where(whole, q, q + same)])
        lo[live[before]] = mid[before] + 1
        hi[live[~before]] = mid[~before]
        live = live[lo[live] < hi[live]]
    return lo


def search_shard(tests: TestSuffixes, rows: list[list[bytes]], longest: bool = False):
    """Matches of one shard: (document, word, test suffix) of every window occurrence and, with
    ``longest``, (length, document, word) of each test suffix' longest verbatim match."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    get = tests.vocab.get
    flat = np.fromiter((get(w, 0) for r in rows for w in r), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(rows)), counts)
    word = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    # stretches of known words within a document, as long as a window at least
    known = flat > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
    stretch = np.cumsum(opens) - 1
    size = np.bincount(stretch[known], minlength=int(opens.sum()))
    least = 1 if longest else tests.shortest
    used = np.flatnonzero(known)
    used = used[size[stretch[used]] >= least]
    # their words with a 0 after each stretch
    gap = np.cumsum(np.append(0, stretch[used][1:] != stretch[used][:-1])) if len(used) else np.zeros(0, np.int64)
    tokens = np.zeros(len(used) + (int(gap[-1]) if len(used) else 0) + tests.longest + 2, np.int64)
    place = np.arange(len(used)) + gap
    tokens[place] = flat[used]
    origin = np.zeros(len(tokens), np.int64)
    origin[place] = used
    order = suffix_array(tokens, tests.longest)
    lo = _search(tests, tokens, order, np.minimum(tests.window, tests.length), False)
    hi = _search(tests, tokens, order, np.minimum(tests.window, tests.length), True)
    n = np.where(tests.is_window, hi - lo, 0)
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    hit = origin[order[at]]
    found = (doc[hit], word[hit], np.repeat(np.arange(len(n)), n))
    if not longest:
        return found, None
    best, where = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    if len(order):
        near = _search(tests, tokens, order, tests.length, False)
        for side in (near - 1, near):
            ok = (side >= 0) & (side < len(order))
            s = order[np.where(ok, side, 0)]
            length = np.where(ok, _common(tests.tokens, tests.suffix, tokens, s, tests.length), 0)
            where = np.where(length > best, origin[s], where)
            best = np.maximum(best, length)
    return found, (best, doc[where] if len(doc) else where, word[where] if len(word) else where)


def _judge(indexes: list[TestSuffixes], texts: list[str | None]):
    """(words, hit words, item ids found) of each text."""
    rows = [words(t) for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    base = np.cumsum(counts) - counts
    hit = np.zeros(int(counts.sum()), bool)
    items: list[set[str]] = [set() for _ in rows]
    for tests in indexes:
        (doc, word, suffix), _ = search_shard(tests, rows)
        start = base[doc] + word
        edge = np.bincount(start, minlength=len(hit) + 1) - np.bincount(start + tests.window[suffix], minlength=len(hit) + 1)
        hit |= np.cumsum(edge[: len(hit)]) > 0
        for d, i in np.unique(np.stack([doc, tests.item[suffix]]), axis=1).T:
            if tests.items[i] is not None:
                items[d].add(tests.items[i])
    n_hit = np.bincount(np.repeat(np.arange(len(rows)), counts), hit, len(rows)).astype(np.int64)
    return counts, n_hit, items


def _indexes(shared: list, window: int):
    """One block's suffixes at a time; a single block is built once per task."""
    if len(shared) == 1:
        one = [TestSuffixes(shared[0].value, window)]
        return lambda: one
    return lambda: (TestSuffixes(b.value, window) for b in shared)


def is_contaminated(n_words: np.ndarray, n_hit: np.ndarray, share: int = MIN_SHARE) -> np.ndarray:
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the item ids found (sorted as text) and contaminated."""
    shared = benchmark_blocks(benchmark)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        indexes = _indexes(shared, window)
        for block in blocks(batches, text_col, SHARD_BYTES):
            n, hit, items = _judge(indexes(), block.column(text_col).to_pylist())
            listed = [sorted(x) for x in items]
            cols = [block.column(id_col), pa.array(n), pa.array(hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(is_contaminated(n, hit))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "n_items", "items", "contaminated"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df``, all columns, whose text is not contaminated."""
    shared = benchmark_blocks(benchmark)

    def run(batches):
        indexes = _indexes(shared, window)
        for block in blocks(batches, text_col, SHARD_BYTES):
            n, hit, _ = _judge(indexes(), block.column(text_col).to_pylist())
            yield block.filter(pa.array(~is_contaminated(n, hit)))

    return map_arrow(df, run, fields(df))


def longest_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per benchmark item and word offset: the longest run of words from there that stands verbatim
    in a document, with that document and its word offset (ties: smallest id, then offset)."""
    from pyspark.sql import functions as F

    shared = benchmark_blocks(benchmark)
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["item_id", "item_word", "length", id_col, "doc_word"]

    def run(batches):
        indexes = _indexes(shared, WINDOW)
        for block in blocks(batches, text_col, SHARD_BYTES):
            rows = [words(t) for t in block.column(text_col).to_pylist()]
            for tests in indexes():
                _, (length, doc, word) = search_shard(tests, rows, longest=True)
                got = np.flatnonzero(length)
                item = [tests.items[i] for i in tests.item[got]]
                cols = [pa.array(item, pa.string()), pa.array(tests.offset[got]), pa.array(length[got]), block.column(id_col).take(pa.array(doc[got])), pa.array(word[got])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    found = map_arrow(df.select(id_col, text_col), run, f"item_id string, item_word long, length long, `{id_col}` {id_type}, doc_word long")
    best = F.min(F.struct(-F.col("length"), F.col(id_col), F.col("doc_word")))
    return found.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", (-F.col("b.col1")).alias("length"), F.col(f"b.{id_col}"), F.col("b.doc_word"))
