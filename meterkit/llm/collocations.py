"""Phrase collocations by prefix-free parsing.

A text (A-Z lower-cased) is split into pieces and these into words. Where the hash of a window of
``OVERLAP`` words of a piece falls on a multiple of ``TRIGGER``, a new chunk opens with that window, and
the chunk before it ends with it; so chunks are cut by content, and copies of a passage give copies
of its chunks. A chunk may span pieces, which stay on lines of their own in it. The distinct chunks of a language with the number of times each was parsed are the
dictionary. A chunk owns the positions up to the next chunk's first word: every phrase of up to
``OVERLAP`` + 1 words of a piece that starts at an owned position lies whole inside the chunk, and the window
two chunks share is owned by the later one, so each occurrence is counted once. Phrases are counted
inside distinct chunks only, weighted by the chunk's frequency.

Phrases are counted length by length: one of n words is counted where both its parts of n-1 words
occur often enough, as any frequent phrase's do. The often enough shorter phrases are known to tasks
as sorted 64-bit hashes, broadcast if they take ``BROADCAST_BYTES`` at most; beyond that, positions
meet them in a shuffle join. Hashes only choose what is counted: counts are grouped by the words
themselves (compared byte by byte inside a block, then by the shuffle's keys). Occurrences are summed inside a block of chunks first, so a phrase in every document
reaches its task once per block.

A phrase's score is its lowest cut's floor(1000 a n / (l r)) in exact decimals.

Defined cases: null, empty and wordless texts have no phrases; a null language is ``und``; repeated
rows count each; ties of cuts go to the shortest first part, ties of rank to the larger count, then
to the phrase in byte order; an empty table, or one in which no phrase is frequent, gives an empty
result. A very long text is cut into chunks like any other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, map_arrow, mix64, texts_of, written

MOST_WORDS = 5
OVERLAP = MOST_WORDS - 1
TRIGGER = 16  # one window in so many opens a chunk
LEAST = 100
TOP = 2000
UNKNOWN = "und"
BLOCK = 1 << 20
BROADCAST_BYTES = 32 << 20
#: A-Z become a-z, the marks between pieces a line end.
_CUT = bytes(0x0A if b in b".,;:!?" or 0x0A <= b <= 0x0D else b for b in range(256)).lower()
_BASE = np.uint64(0x9E3779B97F4A7C15)


_WORD, _SPACE, _BREAK = range(3)
_KIND = np.array([_BREAK if b == 0x0A else _SPACE if b in b" \t" else _WORD for b in range(256)], np.int8)
_CODE = mix64(np.arange(256))  # a random value of each byte
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the hash's base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    return _POWERS


class Words:
    """The words of rows of text, as places in one buffer in which one byte (a space, or a line end
    after a row's last word) follows each word; so a phrase is a stretch of the buffer."""

    def __init__(self, raw: bytes):
        """``raw``: rows that each end with a line end; spaces and tabs stand between words."""
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        word = kind == _WORD
        keep = word.copy()
        keep[1:] |= word[:-1]
        after = np.flatnonzero(keep & ~word)  # the byte after each word
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        self.at = np.flatnonzero(begins)  # where words begin in ``raw``
        self.row = np.searchsorted(np.flatnonzero(kind == _BREAK), self.at)
        self.data = data[keep]
        length = after - self.at
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        same = np.zeros(len(self.end), bool)
        same[:-1] = self.row[1:] == self.row[:-1]
        self.data[self.end] = np.where(same, 0x20, 0x0A)
        with np.errstate(over="ignore"):
            power, self.inverse = _powers(len(self.data))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[self.data] * power[: len(self.data)])])

    def hashes(self, a: np.ndarray, b: np.ndarray, seed=np.uint64(0)) -> np.ndarray:
        """Hash of the words a to b (exclusive) of each pair of word numbers."""
        s, e = self.start[a], self.end[b - 1]
        with np.errstate(over="ignore"):
            return mix64((self.sums[e] - self.sums[s]) * self.inverse[s] + (e - s).astype(np.uint64) * _BASE + seed)

    def texts(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The stretches as an Arrow column."""
        s, e = self.start[a], self.end[b - 1]
        offsets = np.concatenate([[0], np.cumsum(e - s)])
        inside = np.arange(offsets[-1]) + np.repeat(s - offsets[:-1], e - s)
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[inside].tobytes()))

    def groups(self, a: np.ndarray, b: np.ndarray, h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, first): a sorting of the stretches that puts equal ones of equal ``other`` together,
        and where groups begin. Equal hashes are compared byte by byte."""
        order = np.argsort(h)
        first = np.ones(len(h), bool)
        first[1:] = h[order[1:]] != h[order[:-1]]
        lead = np.flatnonzero(first)
        head = np.repeat(order[lead], np.diff(np.append(lead, len(h))))
        s, e, t, f = self.start[a[order]], self.end[b[order] - 1], self.start[a[head]], self.end[b[head] - 1]
        more = np.flatnonzero(~first)
        equal = (e - s == f - t) & (other[order] == other[head])
        if equal.all():
            n = (e - s)[more]
            offsets = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(offsets, n)
            equal = np.array_equal(self.data[np.repeat(s[more], n) + step], self.data[np.repeat(t[more], n) + step])
        if not np.all(equal):  # two stretches with one hash: tell them apart by their bytes
            keys = [(int(o), self.data[x:y].tobytes()) for o, x, y in zip(other, self.start[a], self.end[b - 1])]
            code = pd.factorize(pd.Series(keys))[0]
            order = np.argsort(code, kind="stable")
            first[1:] = code[order[1:]] != code[order[:-1]]
        return order, np.flatnonzero(first)


def parse(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, owned) of the chunks of the texts (``text``: the ascending number of each word's
    text; a row is a piece), as word numbers. Triggering windows lie inside pieces, chunks may span several."""
    n_words = len(words.row)
    at = np.arange(n_words)
    end_of = lambda group: np.searchsorted(group, group, side="right")
    piece_end, text_end = end_of(words.row), end_of(text)
    opens = np.ones(n_words, bool)
    opens[1:] = text[1:] != text[:-1]
    inner = at[~opens & (at + OVERLAP <= piece_end)]
    cut = words.hashes(inner, inner + OVERLAP) % np.uint64(TRIGGER) == 0 if len(inner) else np.zeros(0, bool)
    start = np.sort(np.concatenate([np.flatnonzero(opens), inner[cut]]))
    until = np.append(start[1:], n_words)  # a text's first word follows the last one of the text before
    return start, np.minimum(until + OVERLAP, text_end[start]), until - start


def _parts(batches):
    """(bytes, languages, ends) of about BLOCK bytes of texts: a long text is cut after a piece."""
    held, langs, ends, size = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch, "text")):
            raw = text.encode().translate(_CUT) + b"\n"
            while raw:
                cut = len(raw)
                if size + cut > BLOCK:
                    cut = raw.rfind(b"\n", 0, max(1, BLOCK - size)) + 1 or (len(raw) if size else raw.find(b"\n") + 1)
                    if cut + size > BLOCK and size:
                        yield b"".join(held), langs, ends
                        held, langs, ends, size = [], [], [], 0
                        continue
                held.append(raw[:cut])
                size += cut
                langs.append(lang)
                ends.append(size)
                raw = raw[cut:]
    if held:
        yield b"".join(held), langs, ends


def _dictionary_rows(batches):
    for raw, langs, ends in _parts(batches):
        words = Words(raw)
        text = np.searchsorted(ends, words.at, side="right")
        start, stop, owned = parse(words, text)
        of, names = pd.factorize(np.array(langs, dtype=object))
        lang = of[text[start]]
        other = lang * (1 << 32) + owned
        order, lead = words.groups(start, stop, words.hashes(start, stop, mix64(other)), other)
        one = order[lead]
        times = np.diff(np.append(lead, len(order)))
        rows = [pa.array(names[lang[one]].tolist(), pa.string()), words.texts(start[one], stop[one]), pa.array(owned[one]), pa.array(times)]
        yield pa.RecordBatch.from_arrays(rows, names=["lang", "chunk", "owned", "times"])


def dictionary(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, chunk, owned, times, number) of the distinct chunks, written."""
    source = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    rows = map_arrow(source, _dictionary_rows, "lang string, chunk string, owned long, times long")
    found = rows.groupBy("lang", "chunk", "owned").agg(F.sum("times").alias("times"))
    return written(found.withColumn("number", F.monotonically_increasing_id()), "chunks")


def _gathered(batches):
    """Blocks of about BLOCK bytes of chunks, made of as many batches as that takes."""
    held, size = [], 0
    for block in blocks(batches, "chunk", BLOCK):
        n = pc.sum(pc.binary_length(block.column("chunk"))).as_py()
        if held and size + n > BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(block)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Block:
    """The words of a block of chunks, whose pieces stand on lines of their own."""

    def __init__(self, block: pa.RecordBatch):
        chunks = block.column("chunk")
        whole = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), chunks)
        self.words = Words(pc.binary_join(whole, "\n")[0].as_buffer().to_pybytes() + b"\n")
        ends = np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64) + 1)
        self.chunk = np.searchsorted(ends, self.words.at, side="right")
        self.first = np.searchsorted(self.chunk, np.arange(block.num_rows))
        self.end = np.searchsorted(self.words.row, self.words.row, side="right")
        coded = block.column("lang").dictionary_encode()
        self.langs, self.lang = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        self.seed = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))[self.lang]

    def starts(self, n: int) -> np.ndarray:
        """Words from which n words follow in the piece, themselves included."""
        at = np.arange(len(self.chunk))
        return at[at + n <= self.end]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.words.hashes(at, at + n, self.seed[self.chunk[at]]).view(np.int64)


def _positions(n: int):
    """(hash, number, pos) of every phrase of n words in the chunks, owned or not."""

    def run(batches):
        for block in _gathered(batches):
            b = _Block(block)
            at = b.starts(n)
            number = block.column("number").to_numpy()[b.chunk[at]]
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes(at, n)), pa.array(number), pa.array(at - b.first[b.chunk[at]])], names=["hash", "number", "pos"])

    return run


def _counts(n: int, shared=None):
    """(key, f) of a block's phrases of n words whose parts of n-1 are known: those in
    the sorted hashes ``shared``, or at the positions ``at`` of the chunk where it is None."""

    def run(batches):
        known = None if shared is None else shared.value
        for block in _gathered(batches):
            b = _Block(block)
            at = b.starts(n)
            if n > 1:
                part = np.zeros(len(b.chunk) + 1, bool)
                if known is None:
                    places = block.column("at")
                    part[b.first[np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))] + places.flatten().to_numpy()] = True
                elif len(known):
                    short = b.starts(n - 1)
                    h = b.hashes(short, n - 1)
                    part[short] = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                at = at[part[at] & part[at + 1]]
            owned = block.column("owned").to_numpy()
            at = at[at - b.first[b.chunk[at]] < owned[b.chunk[at]]]
            lang, h = b.lang[b.chunk[at]], b.hashes(at, n)
            order, lead = b.words.groups(at, at + n, h, lang)
            f = np.add.reduceat(block.column("times").to_numpy()[b.chunk[at]][order], lead) if len(lead) else np.zeros(0, np.int64)
            one = order[lead]
            names = pa.DictionaryArray.from_arrays(pa.array(lang[one], pa.int32()), pa.array(b.langs, pa.string())).cast(pa.string())
            key = pc.binary_join_element_wise(b.words.texts(at[one], at[one] + n), names, "\n")
            yield pa.RecordBatch.from_arrays([key, pa.array(f)], names=["key", "f"])

    return run


def _hashed(n: int):
    """(lang, phrase, hash, f) of phrases (lang, phrase, f) of n words."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = _Block(batch.rename_columns(["lang", "chunk", "f"]))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), pa.array(b.hashes(b.first, n)), batch.column("f")], names=["lang", "phrase", "hash", "f"])

    return run


def frequent(chunks: DataFrame, n: int, shorter: DataFrame | None, least: int) -> DataFrame:
    """(lang, phrase, hash, f) of the phrases of n words that occur ``least`` times, written;
    ``shorter``: those of n-1 words. The shuffle carries a phrase and its language as one
    key (a line end, which no phrase holds, between them) and no hash, as that does not compress:
    the phrases that are left get theirs afterwards."""
    schema = "key string, f long"
    if shorter is None:
        rows = map_arrow(chunks, _counts(n), schema)
    elif 8 * shorter.count() <= BROADCAST_BYTES:
        known = np.unique(np.array([r.hash for r in shorter.select("hash").collect()], np.int64))
        rows = map_arrow(chunks, _counts(n, chunks.sparkSession.sparkContext.broadcast(known)), schema)
    else:
        met = map_arrow(chunks.select("lang", "chunk", "number"), _positions(n - 1), "hash long, number long, pos long")
        met = met.join(shorter.select("hash").distinct(), "hash", "left_semi").groupBy("number").agg(F.collect_list("pos").alias("at"))
        rows = map_arrow(chunks.join(met, "number"), _counts(n), schema)
    found = rows.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    end = F.instr("key", "\n")
    found = found.select(F.substring(F.col("key"), end + 1, F.length("key")).alias("lang"), F.substring(F.col("key"), F.lit(1), end - 1).alias("phrase"), "f")
    return written(map_arrow(found, _hashed(n), "lang string, phrase string, hash long, f long"), f"phrases-{n}")


def scores(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases (lang, phrase, words, f) of two words
    and more; all their parts are in ``phrases``, and ``totals`` has (lang, n)."""
    exact = lambda c: f"cast({c} as decimal(20,0))"
    whole = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    cut = whole.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cut = cut.withColumn("left", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn("right", F.expr("array_join(slice(w, k + 1, words), ' ')"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cut = cut.join(totals, "lang").withColumn("score", F.expr(f"(1000 * {exact('f')} * {exact('n')}) div ({exact('l')} * {exact('r')})"))
    low = cut.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("f").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "words", "a", "low.l", "low.r", "n", "low.score")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score."""
    chunks = dictionary(df, lang_col, text_col)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
    levels: list[DataFrame] = []
    for n in range(1, MOST_WORDS + 1):
        levels.append(frequent(chunks, n, levels[-1] if levels else None, least))
    phrases = None
    for n, level in enumerate(levels, 1):
        part = level.select("lang", "phrase", F.lit(n).alias("words"), "f")
        phrases = part if phrases is None else phrases.union(part)
    scored = written(scores(phrases, totals), "scored-phrases")
    inner = scored.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.withColumn("size", F.explode(F.expr("sequence(2, words - 1)"))).withColumn("from", F.explode(F.expr("sequence(1, words - size + 1)")))
    inside = inner.select("lang", F.expr("array_join(slice(w, from, size), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
