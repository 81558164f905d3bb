"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by pattern. The
random field labels words (begin/inside/outside of each kind) from shapes of the word and its
neighbours; it is trained here, in numpy, on the small labelled table below and decoded by
Viterbi in numpy batches. Words of letters only (but for marks at their ends) are outside by
definition. A chain is cut exactly at such words, so only the runs of other words between
them need decoding, which gives the same labels as one chain over the whole text.

The random field adds spans and never removes a base span: a found span that overlaps a base span
is dropped. Offsets are code points, the end exclusive.

Defined cases: null and empty texts have no spans. Rows are judged one by one: repeated rows get
equal results, a null id stays null, an empty table gives an empty result. Spans are listed by
start, then by kind in the order of ``KINDS``. A very long text is read whole, in
time that grows with its length. ``redact`` keeps all columns and a null text null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterkit.llm.common import blocks, fields, map_arrow, texts_of

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

# ---- base patterns ----

_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four patterns, each kind leftmost and non-overlapping, in linear time."""
    out = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append(("ip", at, stop))
                at = stop + 1
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- word shapes ----

CUES = {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "bearer", "auth"}
CALLS = {"call", "phone", "tel", "mobile", "fax", "dial"}
MAILS = {"mail", "email", "contact", "write"}
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"([Aa0])\1+")


def word_features(word: bytes) -> list[str]:
    """Features of one word by itself."""
    core = word.strip(b"\"'`.,;:!?()[]{}<>#*$%&|=")
    shape = core.translate(_SHAPE)
    digits = sum(48 <= b <= 57 for b in core)
    hexed = bool(re.fullmatch(rb"[0-9a-fA-F]{16,}", core))
    mixed = bool(re.fullmatch(rb"[0-9A-Za-z_\-/+]{20,}", core)) and 0 < digits < len(core)
    bare = core.decode(errors="replace").lower()
    parts = core.split(b".")
    ip = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    number = core.replace(b"-", b"")
    flags = {
        "hex": hexed, "hex32": hexed and len(core) >= 32, "mixed": mixed, "at": b"@" in core, "ip": ip,
        "luhn": number.isdigit() and 12 <= len(number) <= 19 and luhn(number.decode()),
        "plus": word.startswith(b"+"), "paren": bool(re.match(rb"\([0-9]+\)", word)), "quote": word[:1] in b"\"'`" and len(word) > 1,
        "cue": bare.strip("_-") in CUES, "call": bare in CALLS, "mailcue": bare in MAILS,
        "local": bool(re.fullmatch(rb"[0-9]{3}-[0-9]{4}", core)), "quad": bool(re.fullmatch(rb"[0-9]{4}", core)), "sign": not core,
    }
    collapsed = _RUN.sub(rb"\1", shape)[:8].decode("latin-1")
    size = next(i for i, most in enumerate((0, 2, 4, 8, 15, 31, 1 << 60)) if len(core) <= most)
    return [f"s={collapsed}", f"n={size}", f"d={min(3, 4 * digits // max(1, len(core)))}", *(k for k, v in flags.items() if v)]


class Field:
    """A trained linear-chain conditional random field."""

    SLOTS = ("0", "-1", "-2", "+1")  # the word itself, the one before, two before, after

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.index, self.emit, self.step, self.first = index, emit, step, first
        self.memo: dict[bytes, np.ndarray] = {}

    def __reduce__(self):
        return Field, (self.index, self.emit, self.step, self.first)

    def scores(self, word: bytes | None) -> np.ndarray:
        """(slots, labels): what this word adds to the position in each slot's place."""
        key = word if word is not None else b"\n"
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            features = word_features(word) if word is not None else ["edge"]
            known = [[self.index[f"{s}:{f}"] for f in features if f"{s}:{f}" in self.index] for s in self.SLOTS]
            self.memo[key] = np.stack([self.emit[k].sum(axis=0) if k else np.zeros(len(LABELS)) for k in known])
        return self.memo[key]

    def emissions(self, context: list[list[bytes | None]]) -> np.ndarray:
        """Scores of positions given as [word, before, two before, after]."""
        return np.stack([sum(self.scores(w)[s] for s, w in enumerate(c)) for c in context])


def viterbi(field: Field, emissions: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best labels of chains that stand one after the other; longer chains go on in fewer rows."""
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    start, size = start[order], length[order]
    most = int(size.max(initial=0))
    score = field.first + emissions[start]
    back = []
    for t in range(1, most):
        n = int(np.searchsorted(-size, -t, side="left"))  # chains longer than t
        ways = score[:n, :, None] + field.step
        best = ways.argmax(axis=1)
        back.append(best)
        score[:n] = np.take_along_axis(ways, best[:, None], axis=1)[:, 0] + emissions[start[:n] + t]
    label = score.argmax(axis=1)
    out = np.zeros(len(emissions), np.int64)
    out[start + size - 1] = label
    for t in range(most - 1, 0, -1):
        n = len(back[t - 1])
        label[:n] = back[t - 1][np.arange(n), label[:n]]
        out[start[:n] + t - 1] = label[:n]
    return out


# ---- open words of a block, by code point classes ----

_CLASS = np.zeros(128, np.uint8)  # 0 mark, 1 white space, 2 letter, 3 digit
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[48:58] = 3


def _chains(texts: list[str]):
    """Runs of open words: (text of each word, first and end code point, context words, chain lengths)."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = np.where(code < 128, _CLASS[np.minimum(code, 127)], 2).astype(np.uint8)
    inside = np.append(False, kind != 1)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin = edge[0::2]
    stop = np.append(edge[1::2], [len(code)] if len(edge) % 2 else []).astype(np.int64)
    if not len(begin):
        return None
    alnum = kind >= 2
    opens = alnum.copy()
    opens[1:] &= ~alnum[:-1]
    runs, digit = np.add.reduceat(opens, begin, dtype=np.int64), np.add.reduceat(kind == 3, begin, dtype=np.int64)
    picked = np.flatnonzero((runs >= 2) | (digit > 0))
    if not len(picked):
        return None
    # a line end between two words ends a chain and hides the neighbour
    lines = np.cumsum(code == 10)
    line = lines[begin]
    size = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(size, begin[picked], side="right")
    first = size[owner] - np.array([len(t) + 1 for t in texts])[owner]

    def near(k):
        other = np.clip(picked + k, 0, len(begin) - 1)
        ok = (picked + k >= 0) & (picked + k < len(begin)) & (line[other] == line[picked])
        return [joined[a:b].encode() if y else None for a, b, y in zip(begin[other].tolist(), stop[other].tolist(), ok)]

    linked = (np.diff(picked) == 1) & (line[picked][1:] == line[picked][:-1])
    chain = np.diff(np.append(np.flatnonzero(np.append(True, ~linked)), len(picked)))
    context = list(map(list, zip(near(0), near(-1), near(-2), near(1))))
    return owner, begin[picked] - first, stop[picked] - first, context, chain


_TRIM = {"phone": re.compile(r"[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z]*\Z", re.S)}
_TRIM_ANY = re.compile(r"[^0-9A-Za-z]*(.*?)[^0-9A-Za-z]*\Z", re.S)


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The spans that the random field finds in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    got = _chains(texts)
    if got is None:
        return out
    owner, begin, stop, context, chain = got
    labels = viterbi(field, field.emissions(context), chain)
    opens = np.zeros(len(labels), bool)
    opens[np.cumsum(chain) - chain] = True
    at, n = 0, len(labels)
    for at in np.flatnonzero(labels).tolist():
        kind = KINDS[(labels[at] - 1) // 2]
        if labels[at] % 2 == 0 and not opens[at] and labels[at - 1] and KINDS[(labels[at - 1] - 1) // 2] == kind:
            continue  # inside
        last = at
        while last + 1 < n and not opens[last + 1] and labels[last + 1] == 2 * KINDS.index(kind) + 2:
            last += 1
        text = texts[owner[at]]
        a, b = int(begin[at]), int(stop[last])
        m = _TRIM.get(kind, _TRIM_ANY).match(text[a:b])
        if m.end(1) > m.start(1):
            out[owner[at]].append((kind, a + m.start(1), a + m.end(1)))
    return out


def all_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, each sorted by start, then kind."""
    rank = lambda s: (s[1], KINDS.index(s[0]), s[2])
    out = []
    for text, found in zip(texts, field_spans(field, texts)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
        added = []
        for kind, a, b in found:
            before = np.searchsorted(starts, b, side="left")
            if not before or reach[before - 1] <= a:
                added.append((kind, a, b))
        out.append((sorted(base, key=rank), sorted([*base, *added], key=rank)))
    return out


# ---- training ----

#: The labelled table: [kind:text] is a span; ~ stands for a digit to be drawn, ^ for a hex digit,
#: {ip} for an address, {card} and {card-} for a card number that passes the check digit, {odd} for
#: sixteen digits that don't.
TABLE = """
token = [secret:"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"] and then
the secret = [secret:^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^] is old
api_key: [secret:'^^^^^^^^^^^^^^^^^^^^^^^^'] was set
token = [secret:"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"]!! the!!
token [secret:^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^]
key = [secret:"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"]### word###
password = [secret:"x~kHq~zr~~p~~aw~Tb~q~w"] here
find [secret:"^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^"] there
write to [email:a^bc.~~@mail~.example.com] today
mail [email:first.last@example.org] or call [phone:+~ (~~~) ~~~-~~~~] now
call [phone:+~~ ~~~ ~~~ ~~~~] at noon
call [phone:(~~~) ~~~-~~~~] at noon
tel [phone:+~ (~~~) ~~~-~~~~], then
reach us at [phone:+~-~~~-~~~-~~~~] soon
some words [phone:+~ (~~~) ~~~-~~~~] [ip:{ip}] and words
some words [ip:{ip}] [card:{card}] and words
the host [ip:{ip}] went down
from [ip:{ip}]. Then
card [card:{card}] was used
paid with [card:{card-}] yesterday
the number [card:{card}] is mine
the number {odd} was odd
card {odd} was refused
words {odd} {odd} words
words {odd} [card:{card}] words
order ~~~~~~~~ came in ~~~~
in ~~~~ and ~~~~ we saw ~ of them
CC BY-NC ~.~. was the license
License, Version ~.~. of it
license, version ~.
at ~~:~~ on ~~~~-~~-~~ they met
from ~~-~~ to ~~-~~ it rained
it costs ~~.~~ or ~,~~~ in all
see e-mail and and/or the well-known case
don't say it's l'eau or d'un
page ~~ of ~~~, line ~
room ~~~-~ on floor ~
version ~.~.~ came after ~.~.~
see http://example.com/a/b?c=~ for it
~~~-~~~~ is a part
the file_name_~.txt and x_~
B2B and H2O in Q3
the range ~-~ and ~~~-~~~
section ~.~.~.~.~ is long
the address ~~~.~~~.~~~ is short
1st 2nd 3rd and 4th
commit ^^^^^^^ came in
"quoted-word" and 'other/word' here
10% of 5kg is 0.5kg
a=b and c==d or x+y
"""


def _draw(rng: np.random.Generator, text: str) -> str:
    def card(valid: bool, dashes: bool) -> str:
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        whole = body + next(str(d) for d in range(10) if luhn(body + str(d)) == valid)
        return "-".join(whole[i : i + 4] for i in range(0, 16, 4)) if dashes else whole

    text = text.replace("{ip}", ".".join(map(str, rng.integers(10, 256, 4))))
    text = re.sub(r"\{(card-?|odd)\}", lambda m: card(m[1] != "odd", m[1] == "card-"), text)
    text = re.sub("~", lambda m: str(rng.integers(0, 10)), text)
    return re.sub(r"\^", lambda m: "0123456789abcdef"[rng.integers(0, 16)], text)


def labelled_rows(copies: int = 8, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table as (text, spans), each row drawn ``copies`` times, once in capitals."""
    rng = np.random.default_rng(seed)
    out = []
    for row in TABLE.strip().split("\n"):
        for copy in range(copies):
            text, spans = "", []
            for piece in re.split(r"(\[[a-z]+:[^\]]*\])", row):
                m = re.fullmatch(r"\[([a-z]+):([^\]]*)\]", piece)
                drawn = _draw(rng, m[2] if m else piece)
                if m:
                    spans.append((m[1], len(text), len(text) + len(drawn)))
                text += drawn
            out.append((text.upper() if copy == 0 else text, spans))
    return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def train(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by forward-backward and Adam over the labelled rows."""
    index: dict[str, int] = {}
    chains = []  # (positions' feature ids, labels)
    for text, spans in rows if rows is not None else labelled_rows():
        got = _chains([text])
        if got is None:
            continue
        _, begin, stop, context, length = got
        label = np.zeros(len(begin), np.int64)
        for kind, a, b in spans:
            for n, i in enumerate(np.flatnonzero((begin < b) & (stop > a))):
                label[i] = LABELS.index(f"{'BI'[n > 0]}-{kind}")
        ids = []
        for c in context:
            ids.append([index.setdefault(f"{s}:{f}", len(index)) for s, w in zip(Field.SLOTS, c) for f in (word_features(w) if w is not None else ["edge"])])
        at = 0
        for n in length:
            chains.append((ids[at : at + n], label[at : at + n]))
            at += n
    k, n_all = len(LABELS), len(chains)
    widest = max((len(i) for ids, _ in chains for i in ids), default=0)
    p = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]  # the last feature fills up
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    groups = []  # chains of one length together
    for n in sorted({len(label) for _, label in chains}):
        same = [(ids, label) for ids, label in chains if len(label) == n]
        groups.append((n, np.array([[i + [len(index)] * (widest - len(i)) for i in ids] for ids, _ in same]), np.array([label for _, label in same])))
    for step in range(1, rounds + 1):
        g = [decay * x * n_all for x in p]
        for n, ids, label in groups:
            each = np.arange(len(ids))
            e = p[0][ids].sum(axis=2)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = p[2] + e[:, 0]
            for t in range(1, n):
                alpha[:, t] = e[:, t] + _logsum(alpha[:, t - 1, :, None] + p[1], 1)
            for t in range(n - 2, -1, -1):
                beta[:, t] = _logsum(p[1] + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
            z = _logsum(alpha[:, -1], 1)
            near = np.exp(alpha + beta - z[:, None, None])
            near[each[:, None], np.arange(n), label] -= 1
            np.add.at(g[0], ids, near[:, :, None])
            g[2] += near[:, 0].sum(axis=0)
            for t in range(1, n):
                pair = np.exp(alpha[:, t - 1, :, None] + p[1] + (e[:, t] + beta[:, t])[:, None] - z[:, None, None])
                pair[each, label[:, t - 1], label[:, t]] -= 1
                g[1] += pair.sum(axis=0)
        g[0][-1] = 0
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(index, *p)


# ---- operators ----


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base spans and all spans, each as text kind:start:end joined by commas, and
    the spans as an array of structs."""
    id_type = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for block in blocks(batches, text_col):
            got = all_spans(field, texts_of(block, text_col))
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in every] for _, every in got]
            cols = [block.column(id_col), pa.array([_listed(b) for b, _ in got]), pa.array([_listed(s) for _, s in got]), pa.array(rows, span)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "base", "spans", "found"])

    return map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {id_type}, base string, spans string, found array<struct<kind: string, start: bigint, end: bigint>>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each maximal stretch of spans becomes <KIND> of its first span."""
    out, at, merged = [], 0, []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with every found span replaced by its kind in angle brackets."""
    place = df.columns.index(text_col)

    def run(batches):
        for block in blocks(batches, text_col):
            texts = texts_of(block, text_col)
            clean = [redacted(t, every) for t, (_, every) in zip(texts, all_spans(field, texts))]
            column = pa.array([None if old is None else new for old, new in zip(block.column(text_col).to_pylist(), clean)], pa.string())
            yield block.set_column(place, text_col, column)

    return map_arrow(df, run, fields(df))
