"""Repetition rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are ASCII-white-space separated. Every n-gram length from 2 to 10 gets a rolling hash
(the hash of length n extends the one of length n-1 by one word), computed in numpy over a
block of documents at once. Equal hashes inside one document are repeats; they are compared
word by word before they count.

Defined cases: a null or empty text has no words, counts of 0 and fails the base rule. Rows are
judged one by one, so repeated rows get equal results, a null id stays null and an empty table
gives an empty result. A very long text is judged whole, alone in its block.
Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterkit.llm.common import blocks, map_arrow, mix64, texts_of, word_table

# Largest share of characters (in percent) in the most frequent n-gram, in repeated
# n-grams and in repeated lines, after the published rules of the MassiveText corpus.
TOP_PERCENT = {2: 20, 3: 18, 4: 16}
DUP_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_PERCENT = 20
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COVERS = ["dup_line_chars", *(f"top{n}_chars" for n in TOP_PERCENT), *(f"dup{n}_chars" for n in DUP_PERCENT)]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of equal keys: a sorting order that keeps positions ascending, and where a new key starts."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, first


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> bool:
    return all(np.array_equal(ids[a + k], ids[b + k]) for k in range(n))


def _repeats(ids, keys, at, n):
    """Positions among ``at`` whose n-gram occurs again in its document: (positions, later than
    the first, size of the group each belongs to)."""
    order, first = _runs(keys)
    pos = at[order]
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(pos)))
    lead = np.repeat(pos[starts], size)
    again = np.repeat(size, size) > 1
    if not _same(ids, pos[again], lead[again], n):  # two n-grams with one hash: compare the words themselves
        grams = np.stack([ids[at + k] for k in range(n)] + [keys.view(np.int64)], axis=1)
        return _repeats(ids, np.unique(grams, axis=0, return_inverse=True)[1].ravel(), at, n)
    return pos[again], pos[again] != lead[again], np.repeat(size, size)[again]


def _signals(texts: list[str]) -> dict[str, np.ndarray]:
    raw = [t.encode() for t in texts]
    n_docs = len(raw)
    doc, ids, distinct = word_table([r.split() for r in raw])
    chars = np.fromiter((len(w.decode()) for w in distinct), np.int64, len(distinct))[ids]
    total = lambda w: np.bincount(doc, w, n_docs).astype(np.int64)
    out = {"n_words": total(None), "word_chars": total(chars)}
    out["n_symbols"] = np.fromiter((sum(r.count(s) for s in SYMBOLS) for r in raw), np.int64, n_docs)
    dup_lines, dup_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i, r in enumerate(raw):
        seen: set[bytes] = set()
        for line in r.split(b"\n"):
            words = line.split()
            if words:
                if line in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += sum(len(w.decode()) for w in words)
                seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars}

    # rolling hashes: key of (document, n-gram) = key of (n-1)-gram * base + next word
    word_hash, base = mix64(ids), np.uint64(0x9E3779B97F4A7C15 | 1)
    n_all = len(ids)
    roll = word_hash + mix64(doc + (1 << 40))
    last = np.cumsum(np.bincount(doc, minlength=n_docs))[doc] - 1  # last word of the own document
    at = np.arange(n_all)
    with np.errstate(over="ignore"):
        for n in range(2, 11):
            roll = roll[: max(0, n_all - n + 1)] * base + word_hash[n - 1 :]
            at = at[at + n - 1 <= last[at]]
            pos, later, size = _repeats(ids, mix64(roll[at]), at, n)
            if n == 3:
                out["n_repeat_words"] = total(_covered(pos, n, n_all))
            if n in TOP_PERCENT:
                best = np.zeros(n_docs, np.int64)
                np.maximum.at(best, doc[pos], size * sum(chars[pos + k] for k in range(n)))
                out[f"top{n}_chars"] = best
            if n in DUP_PERCENT:
                out[f"dup{n}_chars"] = total(_covered(pos[later], n, n_all) * chars)
            # a repeated (n+1)-gram starts and goes on with repeated n-grams
            repeated = np.zeros(n_all + 1, bool)
            repeated[pos] = True
            at = np.flatnonzero(repeated[:-1] & repeated[1:])
    return out


def _covered(pos: np.ndarray, n: int, n_all: int) -> np.ndarray:
    edge = np.bincount(pos, minlength=n_all + n + 1) - np.bincount(pos + n, minlength=n_all + n + 1)
    return np.cumsum(edge[:n_all]) > 0


def _verdict(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    over = 100 * s["dup_line_chars"] > LINE_PERCENT * s["word_chars"]
    for n, most in TOP_PERCENT.items():
        over |= 100 * s[f"top{n}_chars"] > most * s["word_chars"]
    for n, most in DUP_PERCENT.items():
        over |= 100 * s[f"dup{n}_chars"] > most * s["word_chars"]
    return failed, ~failed & ~over


def quality_signals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, characters in repeated units, base_failed and kept."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for block in blocks(batches, text_col):
            s = _signals(texts_of(block, text_col))
            failed, kept = _verdict(s)
            cols = [block.column(id_col), *(pa.array(s[c]) for c in COUNTS), pa.array(failed), pa.array(kept), *(pa.array(s[c]) for c in COVERS)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, *COUNTS, "base_failed", "kept", *COVERS]
    kinds = [id_type, *["long"] * len(COUNTS), "boolean", "boolean", *["long"] * len(COVERS)]
    return map_arrow(df.select(id_col, text_col), run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
