"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Two gated recurrent passes (left to
right and right to left) run over each window, a softmax over both states labels every byte
position, and the document's distribution is the mean over all its positions, so whole texts
count at any length. The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled rows: at most ``SAMPLE_DOCS`` documents of each language, picked by a
hash of the document in ``SALTS`` equal parts (so no task ranks a whole language), and
``SAMPLE_WINDOWS`` windows of each. Gates and candidate use the softsign
curve, which needs no exponentials.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. A null lang never
trains; without any labelled row every text is ``und``. Rows are judged one by one: repeated rows
get equal results, a null id stays null (and does not train), an empty table gives an empty
result. Equal probabilities go to the language that sorts first. A very long text is
read whole, in windows. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, fields, map_arrow

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 6
SALTS = 16
MIN_SCORE = 0.4
PAD = 256
RUN = 2048  # windows in one numpy step
_LETTER = re.compile(r"[^\W\d_]")


def _d_soft(y):
    """Slope of softsign where it has the value y."""
    return (1 - np.abs(y)) ** 2


def _windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) byte values, the last window filled up with PAD."""
    a = np.frombuffer(raw, np.uint8)
    n = -(-len(a) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(a)] = a
    return out.reshape(n, WINDOW)


def _init(rng: np.random.Generator, n_langs: int, hidden: int) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.5, (PAD + 1, 3 * hidden))
        p[f"{d}u"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"{d}o"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, n_langs))
    p["bias"] = np.zeros(n_langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _pass(x: np.ndarray, wx: np.ndarray, wu: np.ndarray, keep: bool = False):
    """States (steps + 1, hidden, batch) of one direction; x is (steps, batch). With ``keep`` also
    what backpropagation needs of every step."""
    steps, n = x.shape
    h_dim = wu.shape[0]
    table, weight = np.ascontiguousarray(wx.T), np.ascontiguousarray(wu.T)
    states = np.empty((steps + 1, h_dim, n), np.float32)
    states[0] = 0
    trace = []
    a, u = np.empty((3 * h_dim, n), np.float32), np.empty((3 * h_dim, n), np.float32)
    s = np.empty((2 * h_dim, n), np.float32)
    for t in range(steps):
        if keep:
            a, u = np.empty_like(a), np.empty_like(u)
        h, after = states[t], states[t + 1]
        np.take(table, x[t], axis=1, out=a, mode="clip")
        np.matmul(weight, h, out=u)
        gates, c, un = a[: 2 * h_dim], a[2 * h_dim :], u[2 * h_dim :]
        gates += u[: 2 * h_dim]
        np.abs(gates, out=s)
        s += 1
        gates /= s
        soft = gates.copy() if keep else None
        gates *= 0.5
        gates += 0.5
        z, r = gates[:h_dim], gates[h_dim:]
        c += np.multiply(r, un, out=s[:h_dim])
        np.abs(c, out=s[:h_dim])
        s[:h_dim] += 1
        c /= s[:h_dim]
        if keep:
            trace.append((soft, z, r, un, c))
        np.subtract(h, c, out=after)
        after *= z
        after += c
    return states, trace


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the axis of languages, in place; logits is (steps, langs, batch)."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _labels(p: dict[str, np.ndarray], fwd: np.ndarray, bwd: np.ndarray) -> np.ndarray:
    logits = p["fo"].T @ fwd[1:]
    logits += p["bo"].T @ bwd[1:][::-1]
    logits += p["bias"][:, None]
    return _softmax(logits)


def position_probs(p: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """(WINDOW, langs, n): the label distribution of every byte position of every window."""
    x = np.ascontiguousarray(windows.T, dtype=np.intp)
    return _labels(p, _pass(x, p["fx"], p["fu"])[0], _pass(x[::-1], p["bx"], p["bu"])[0])


def _gradients(p: dict[str, np.ndarray], windows: np.ndarray, target: np.ndarray):
    """Loss and gradients of the mean cross-entropy over real positions (truncated at no step)."""
    x = np.ascontiguousarray(windows.T, dtype=np.intp)
    real = (x != PAD)[:, None]
    n_real, each = max(1, int(real.sum())), np.arange(len(target))
    runs = {"f": (x, *_pass(x, p["fx"], p["fu"], keep=True)), "b": (x[::-1], *_pass(x[::-1], p["bx"], p["bu"], keep=True))}
    d_logits = _labels(p, runs["f"][1], runs["b"][1])
    loss = float(-(np.log(d_logits[:, target, each] + 1e-9) * real[:, 0]).sum() / n_real)
    d_logits[:, target, each] -= 1
    d_logits *= real / np.float32(n_real)
    g = {"bias": d_logits.sum((0, 2))}
    for d, (xs, states, trace) in runs.items():
        dl = d_logits if d == "f" else d_logits[::-1]
        g[f"{d}o"] = np.matmul(states[1:], dl.transpose(0, 2, 1)).sum(0)
        d_state = p[f"{d}o"] @ dl
        gx, gu = np.zeros_like(p[f"{d}x"]), np.zeros_like(p[f"{d}u"])
        h_dim, carry = gu.shape[0], 0
        for t in range(len(trace) - 1, -1, -1):
            soft, z, r, un, c = trace[t]
            h = states[t]
            dh = d_state[t] + carry
            dz = dh * (h - c) * 0.5 * _d_soft(soft[:h_dim])
            dc = dh * (1 - z) * _d_soft(c)
            dr = dc * un * 0.5 * _d_soft(soft[h_dim:])
            du = np.concatenate([dz, dr, dc * r])
            for j, row in enumerate((*dz, *dr, *dc)):
                gx[:, j] += np.bincount(xs[t], row, PAD + 1)
            gu += h @ du.T
            carry = dh * z + p[f"{d}u"] @ du
        g[f"{d}x"], g[f"{d}u"] = gx, gu
    return loss, g


def fit(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = 120, batch: int = 256, rate: float = 0.02, seed: int = 7) -> dict:
    """Train on (lang, bytes of a window) rows with Adam. Returns {"langs": [...], "params": {...}}."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return {"langs": [], "params": {}}
    rng = np.random.default_rng(seed)
    cut = [(langs.index(lang), w) for lang, raw in samples for w in _windows(raw)]
    target = np.array([k for k, _ in cut])
    windows = np.stack([w for _, w in cut]) if cut else np.zeros((0, WINDOW), np.int16)
    p = _init(rng, len(langs), hidden)
    m, v = {k: 0.0 for k in p}, {k: 0.0 for k in p}
    weight = 1 / np.maximum(1, np.bincount(target, minlength=len(langs)))
    share = weight[target] / weight[target].sum() if len(target) else None
    for step in range(1, steps + 1) if len(target) else ():
        pick = rng.choice(len(target), size=batch, p=share)  # languages drawn evenly
        _, g = _gradients(p, windows[pick], target[pick])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return {"langs": langs, "params": p}


def labelled_sample(df: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """The bounded training sample: per language at most ``docs`` documents by hash, ``windows``
    stretches of WINDOW characters of each at hashed places. Only those stretches reach the driver."""
    place = f"1 + pmod(xxhash64(`{key_col}`, i), greatest(1, length(`{text_col}`) - {WINDOW} + 1))"
    cuts = F.expr(f"transform(sequence(1, {windows}), i -> substring(`{text_col}`, cast({place} as int), {WINDOW}))")
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod("order", F.lit(SALTS))).orderBy("order", "key"))
    picked = (
        df.where(F.col(lang_col).isNotNull() & F.col(key_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(lang_col).alias("lang"), F.xxhash64(key_col).alias("order"), F.col(key_col).alias("key"), cuts.alias("cuts"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= max(1, docs // SALTS))
        .select("lang", "order", "key", "cuts")
    )
    rows = sorted(picked.collect(), key=lambda r: (r.lang, r.order, str(r.key), r.cuts))
    return [(r.lang, c.encode()[:WINDOW]) for r in rows for c in r.cuts if _LETTER.search(c)]


def predict_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    langs, p = model["langs"], model["params"]
    known = [i for i, t in enumerate(texts) if langs and t and _LETTER.search(t)]
    cut = [_windows(texts[i].encode()) for i in known]
    owner = np.repeat(np.arange(len(known)), [len(c) for c in cut])
    pooled = np.zeros((len(known), len(langs)))
    length = np.zeros(len(known))
    stack = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.int16)
    for at in range(0, len(stack), RUN):
        part, who = stack[at : at + RUN], owner[at : at + RUN]
        real = part.T != PAD
        probs = position_probs(p, part)
        if not real.all():
            probs *= real[:, None]
        summed = probs.sum(axis=0, dtype=np.float64)
        for k in range(len(langs)):
            pooled[:, k] += np.bincount(who, summed[k], len(known))
        length += np.bincount(who, real.sum(axis=0), len(known))
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if known:
        pooled /= length[:, None]
        best = pooled.argmax(axis=1)
        score[known] = np.clip(pooled.max(axis=1), 0, 1)
        for i, k in zip(known, best):
            lang[i] = langs[k]
    return lang, score


def predict(df: DataFrame, model: dict, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``df`` with the predicted language and its mean probability added at the end (columns of
    those names are replaced)."""
    df = df.drop(lang_name, score_name)

    def run(batches):
        for block in blocks(batches, text_col):
            lang, score = predict_texts(model, block.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(lang, pa.string()), pa.array(score)], names=names)

    names = [*df.columns, lang_name, score_name]
    return map_arrow(df, run, f"{fields(df)}, `{lang_name}` string, `{score_name}` double")


def held_out(key: str = "doc_id"):
    """True for the quarter of documents that never trains; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, key_col: str = "doc_id") -> dict:
    return fit(labelled_sample(df.where(~held_out(key_col)), key_col=key_col))
