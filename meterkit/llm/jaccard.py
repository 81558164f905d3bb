"""Exact Jaccard self-join of documents' word n-gram sets by a partitioned universe.

Two sets of sizes a <= b with Jaccard >= t/100 differ in at most K = (100-t)(a+b)/(100+t) elements.
Sizes fall into bands; in a band the universe is hashed into m = K+1+slack segments, so a linked
pair agrees on whole segments, or comes within one element on some. Each set indexes

* every segment's subset under a key, and
* for the first ``RESERVED`` segments also every subset with one element taken away.

Each set then allocates its K+1 units where they cost least: a segment may be skipped (0 units),
looked up exactly (1) or, if reserved, looked up with its one-deletion neighbourhood (2). The cost
is how often the keys occur among the documents around it; empty segments cost most. Costs only
steer the choice: any allocation of K+1 units meets every linked partner, so no cap or sample
decides a result. A set close above a band's end also looks up its units in the band below.

Identical sets are one class (a 128-bit digest of the set). A first pass over all texts finds the
classes that meet another one under a key; only their sets are gathered. Counting the elements of
those sets gives each class its number of elements that no other has, u: it shares at most n-u
elements with any other, which rules out most pairs of loosely similar copies without a look at
them (a class that no partner of any size could link to is dropped). Then the members of a key are
tied to one of them, the hub with the smallest u (the likely origin of a group of copies), not
paired with each other; ties are verified exactly on the sets and linked classes contract into
components. A key whose members are still in different components gets the pairs between its
components verified that n, u and the sizes leave possible, so no link is lost, and members that
are already connected are never paired. Groups inside a block of documents are tied to a hub before
the shuffle, so a large group reaches it as one row per block and key.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing. A
text of fewer words than n is one shingle. Repeated rows are members of one class; a null id has
its own row and never is a component's id unless the component has no other; an empty table gives
an empty result. Columns besides the id and the text are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterkit.llm.common import blocks, fresh, map_arrow, mix64, texts_of, word_table, written
from meterkit.llm.components import components

RATIO = 1.5  # of a size band's ends
RESERVED = 2  # segments with one-deletion neighbourhoods
BLOCK = 1 << 20  # bytes of text, or of sets, in one numpy step: what a Python worker holds at once
SKETCH_WORDS = 4  # of 64 parts of the universe each, a power of two
TIE = 4  # rows of one key in a block from which they are tied before the shuffle
BROADCAST_ROWS = 500_000  # of (id, 16-byte class): under 32 MB
EXACT_PROBE, NEAR_PROBE, EXACT, NEAR = range(4)  # kinds of rows, in the order in which a key's hub is chosen

_U = np.uint64


# ---- sets ----


def shingles(texts: list[str], n: int):
    """(sizes, first position of each text, sorted distinct hashes) of the texts' n-word sets."""
    doc, ids, distinct = word_table([t.encode().lower().split() for t in texts])
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[ids]
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.cumsum(count) - count
    at = np.arange(len(word))
    at = at[at + n <= (first + count)[doc]] if len(word) else at
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + word[at + k]
        h = mix64(h)
        owner = doc[at]
        if len(short):  # the whole sequence as one shingle, marked by its length
            whole = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                more = k < count[short]
                whole = np.where(more, whole * _U(0x9E3779B97F4A7C15) + word[np.where(more, first[short] + k, 0)], whole)
            h = np.concatenate([h, mix64(whole + mix64(count[short].astype(np.uint64) + _U(1 << 50)))])
            owner = np.concatenate([owner, short])
    order = np.argsort(h)
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    size = np.bincount(owner, minlength=len(texts))
    return size, np.cumsum(size) - size, h


def _sum_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, group, values)
    return out


def class_of(size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's digest."""
    owner = np.repeat(np.arange(len(size)), size)
    tag = mix64(size.astype(np.uint64))
    with np.errstate(over="ignore"):
        return tuple(mix64(_sum_by(mix64(h ^ _U(salt)), owner, len(size)) + tag).view(np.int64) for salt in (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C))


# ---- bands and bounds ----


class Bands:
    """Size bands and the largest difference of linked sets, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        high = [1]
        while high[-1] < 1 << 40:
            high.append(max(high[-1] + 1, int((high[-1] + 1) * RATIO), self.partner(high[-1])))
        self.high = np.array(high)

    def partner(self, size):
        """Largest size that a linked set of this size can have."""
        return 100 * size // self.percent

    def differ(self, a, b):
        """Most elements in which linked sets of sizes a and b differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def band(self, size):
        return np.searchsorted(self.high, size)

    def segments(self, band):
        most = self.differ(self.high[band], self.partner(self.high[band]))
        return np.where(most > 0, most + 2 + most // 8, 0)


# ---- keys of a block ----


def _subsets(size, start, h, rows, band, segments):
    """Segment sums of the sets ``rows`` in their bands."""
    m = segments[np.arange(len(rows))]
    base = np.cumsum(m) - m
    n = size[rows]
    token = np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    row = np.repeat(np.arange(len(rows)), n)
    spread = mix64(h[token] + _U(0x5851F42D4C957F2D))
    seg = ((spread >> _U(32)) * m[row].astype(np.uint64) >> _U(32)).astype(np.int64)
    value = mix64(h[token] ^ _U(0x14057B7EF767814F))
    total = int(m.sum())
    sums = _sum_by(value, base[row] + seg, total)
    filled = np.bincount(base[row] + seg, minlength=total)
    owner = np.repeat(np.arange(len(rows)), m)
    number = np.arange(total) - np.repeat(base, m)
    name = mix64((band[owner].astype(np.uint64) << _U(40)) | number.astype(np.uint64))
    reserved = seg < RESERVED
    with np.errstate(over="ignore"):
        keys = mix64(sums + name)
        at = (base[row] + seg)[reserved]
        near = mix64(sums[at] - value[reserved] + name[at])
    return owner, number, filled, keys, row[reserved], seg[reserved], near


def _allocate(n_rows, m, need, owner, number, filled, keys, near_row, near_seg, near):
    """(looked up, near looked up): which keys carry a row's K+1 units at least cost."""
    every, inverse, times = np.unique(np.concatenate([keys, near]), return_inverse=True, return_counts=True)
    others = times[inverse] - 1
    cost = others[: len(keys)] * 64 + 63 - np.minimum(filled, 63) + np.where(filled == 0, 1 << 40, 0)
    order = np.lexsort((-cost, owner))  # dearest first within a row
    base = np.cumsum(m) - m
    free = m - need  # segments that may be skipped
    skipped = np.zeros(len(keys), bool)
    skipped[order] = np.arange(len(keys)) - base[owner] < free[owner]
    near_cost = np.bincount(near_row * RESERVED + near_seg, others[len(keys) :] + 1, n_rows * RESERVED).reshape(n_rows, RESERVED)
    raised = np.zeros((n_rows, RESERVED), bool)
    up = np.zeros(n_rows, np.int64)
    each = np.arange(n_rows)
    for seg in range(RESERVED):  # two units here let one more dear segment be skipped
        place = base + np.minimum(free + up, m - 1)
        next_seg = order[place]
        ok = (free + up < m) & (seg < m) & ~skipped[base + np.minimum(seg, m - 1)] & (number[next_seg] != seg) & ~raised[each, np.minimum(number[next_seg], RESERVED - 1)]
        ok &= cost[next_seg] > 64 * (1 + near_cost[:, seg])
        skipped[next_seg[ok]] = True
        raised[ok, seg] = True
        up += ok
    return ~skipped, raised[near_row, near_seg]


def block_rows(bands: Bands, size, start, h, c1, c2):
    """Rows (key, c1, c2, kind) of a block's sets: all index rows of their bands and the look-ups."""
    out = []
    own = bands.band(size)
    for lower in (False, True):
        band = own - lower
        m = np.where(band >= 0, bands.segments(np.maximum(band, 0)), 0)
        m[size == 0] = 0
        top = bands.high[np.maximum(band, 0)]
        if lower:  # only sets that a partner in the band below can reach
            m[bands.partner(top) < size] = 0
            need = bands.differ(size, top) + 1
        else:
            need = bands.differ(size, np.minimum(top, bands.partner(size))) + 1
        rows = np.flatnonzero(m > 0)
        if not len(rows):
            continue
        m, need = m[rows], np.minimum(need[rows], m[rows])
        owner, number, filled, keys, near_row, near_seg, near = _subsets(size, start, h, rows, band[rows], m)
        looked, raised = _allocate(len(rows), m, need, owner, number, filled, keys, near_row, near_seg, near)
        if lower:
            out += [(keys[looked], rows[owner[looked]], EXACT_PROBE), (near[raised], rows[near_row[raised]], NEAR_PROBE)]
        else:
            out += [(keys, rows[owner], np.where(looked, EXACT_PROBE, EXACT)), (near, rows[near_row], np.where(raised, NEAR_PROBE, NEAR))]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    key = np.concatenate([k for k, _, _ in out]).view(np.int64)
    who = np.concatenate([w for _, w, _ in out])
    kind = np.concatenate([np.broadcast_to(np.asarray(x, np.int64), len(k)) for k, _, x in out])
    return key, c1[who], c2[who], kind


def _grouped(key, c1, c2, kind):
    """Rows sorted by key, kind and class, without repeated classes under a key; and where keys start."""
    order = np.lexsort((c2, c1, kind, key))
    key, c1, c2, kind = key[order], c1[order], c2[order], kind[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (kind[1:] != kind[:-1])
    key, c1, c2, kind = key[new], c1[new], c2[new], kind[new]
    opens = np.ones(len(key), bool)
    opens[1:] = key[1:] != key[:-1]
    return key, c1, c2, kind, opens


def tie_block(key, c1, c2, kind):
    """Tie large groups of a key inside a block to its hub: the hub's row stays, and each tie goes on
    as two rows under a key of its own."""
    key, c1, c2, kind, opens = _grouped(key, c1, c2, kind)
    if not len(key):
        return key, c1, c2, kind
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, len(key)))
    hub = np.repeat(first, count)
    tied = (np.repeat(count, count) >= TIE) & (kind[hub] == EXACT_PROBE) & ~opens
    a1, a2, b1, b2 = c1[tied], c2[tied], c1[hub[tied]], c2[hub[tied]]
    ties = np.unique(np.stack([a1, a2, b1, b2]), axis=1) if len(a1) else np.zeros((4, 0), np.int64)
    ties = ties[:, (ties[0] != ties[2]) | (ties[1] != ties[3])]
    with np.errstate(over="ignore"):
        name = mix64(mix64(ties[0].view(np.uint64) + _U(1)) + ties[2].view(np.uint64)).view(np.int64)
    same = np.zeros(2 * len(name), np.int64)
    return (
        np.concatenate([key[~tied], name, name]),
        np.concatenate([c1[~tied], ties[0], ties[2]]),
        np.concatenate([c2[~tied], ties[1], ties[3]]),
        np.concatenate([kind[~tied], same]),
    )


def _hubs(batches, whole: bool = False):
    """From batches sorted by key and kind: the batch's columns and those of each row's hub, for the
    rows that their key's hub has to meet; with ``whole`` for all rows of keys with more than one."""
    last = None  # the hub at the end of the batch before
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = {f: batch.column(f).to_numpy() for f in batch.schema.names}
        opens = np.ones(n, bool)
        opens[1:] = cols["key"][1:] != cols["key"][:-1]
        hub = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        head = {f: c[hub] for f, c in cols.items()}
        if last is not None and cols["key"][0] == last["key"]:
            head = {f: np.where(hub == 0, last[f], c) for f, c in head.items()}
        last = {f: c[-1] for f, c in head.items()}
        if whole:  # the first and last key may go on in another batch
            edge = (cols["key"] == cols["key"][0]) | (cols["key"] == cols["key"][-1])
            use = edge | (np.bincount(hub, minlength=n)[hub] > 1)
            use &= head["kind"] <= NEAR_PROBE
        else:
            use = (head["kind"] <= NEAR_PROBE) & ((cols["c1"] != head["c1"]) | (cols["c2"] != head["c2"])) & ((head["kind"] == EXACT_PROBE) | (cols["kind"] != NEAR))
        yield {f: c[use] for f, c in cols.items()}, {f: c[use] for f, c in head.items()}


def _met(batches):
    """The classes that meet another one under a key."""
    for row, hub in _hubs(batches):
        both = np.unique(np.stack([np.concatenate([row[f], hub[f]]) for f in ("c1", "c2")]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["c1", "c2"])


# ---- the join ----


def _documents(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, hash of the text, n_shingles, c1, c2) of every row."""
    id_type = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))

    def run(batches):
        for block in blocks(batches, "text", BLOCK):
            size, _, h = shingles(texts_of(block, "text"), n)
            c1, c2 = class_of(size, h)
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("hash"), pa.array(size), pa.array(c1), pa.array(c2)], names=["id", "hash", "n", "c1", "c2"])

    return map_arrow(source, run, f"id {id_type}, hash long, n long, c1 long, c2 long")


def _rows(df: DataFrame, text_col: str, n: int, bands: Bands) -> DataFrame:
    """Index rows and look-ups of every text, large groups of a block tied."""
    def run(batches):
        for block in blocks(batches, text_col, BLOCK):
            size, start, h = shingles(texts_of(block, text_col), n)
            rows = tie_block(*block_rows(bands, size, start, h, *class_of(size, h)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows[:3]), pa.array(rows[3].astype(np.int8))], names=["key", "c1", "c2", "kind"])

    return map_arrow(df.select(text_col), run, "key long, c1 long, c2 long, kind byte")


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(class, size, set) of the classes in ``wanted`` (id, c1, c2), one row each."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    texts = texts.join(side, texts["__id"].eqNullSafe(side["id"])).select("__text", "c1", "c2")

    def run(batches):
        for block in blocks(batches, "__text", BLOCK):
            size, start, h = shingles(texts_of(block, "__text"), n)
            c1, c2 = class_of(size, h)
            right = (c1 == block.column("c1").to_numpy()) & (c2 == block.column("c2").to_numpy())
            whole = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)), pa.int32()), pa.array(h.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(size), whole], names=["c1", "c2", "n", "items"])
            yield rows.filter(pa.array(right))  # another text under the same id

    found = map_arrow(texts, run, "c1 long, c2 long, n long, items array<long>")
    return found.dropDuplicates(["c1", "c2"]).select(F.struct("c1", "c2").alias("c"), "n", "items")


def _parts(items: str, prefix: str) -> list:
    """SKETCH_WORDS columns of 64 bits: which of the universe's parts hold one of the items."""
    part = f"filter({items}, t -> (shiftright(t, 6) & {SKETCH_WORDS - 1}) = %d)"
    return [F.expr(f"aggregate({part % k}, 0L, (s, t) -> s | shiftleft(1L, cast(t & 63 as int)))").alias(f"{prefix}{k}") for k in range(SKETCH_WORDS)]


def _overlaps(pairs: DataFrame, sets: DataFrame, sketch: bool = False) -> DataFrame:
    """(a, b, na, nb, both): sizes and shared elements of the pairs' sets; with ``sketch`` also in
    which parts of the universe a (b) lacks elements of the other: la0.. (lb0..)."""
    left = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(left, "a").join(right, "b")
    lacks = [*_parts("array_except(ib, ia)", "la"), *_parts("array_except(ia, ib)", "lb")] if sketch else []
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).cast("bigint").alias("both"), *lacks)


def _reaches(percent: int) -> str:
    return f"100 * both >= {percent} * (na + nb - both)"


def _alone(sets: DataFrame) -> DataFrame:
    """(c, u): how many elements of each set are in no other set."""
    single = sets.select("c", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n = 1")
    return single.groupBy("c").agg(F.count("*").alias("u"))


def possible(percent: int, a: str = "a", b: str = "b") -> str:
    """SQL: by sizes n and own elements u, the sets could reach the threshold."""
    return f"{100 + percent} * least(n{a} - u{a}, n{b} - u{b}) >= {percent} * (n{a} + n{b}) and 100 * least(n{a}, n{b}) >= {percent} * greatest(n{a}, n{b})"


def _set_rows(sets: DataFrame, bands: Bands) -> DataFrame:
    """Index rows and look-ups of gathered sets (c, n, u, items), with n and u."""
    def run(batches):
        for block in blocks(batches, "items", BLOCK):
            items = block.column("items")
            c1, c2, own = (block.column(f).to_numpy() for f in ("c1", "c2", "u"))
            size = np.diff(items.offsets.to_numpy()).astype(np.int64)
            h = items.flatten().to_numpy().view(np.uint64)
            at = np.arange(len(size))
            key, who, _, kind = block_rows(bands, size, np.cumsum(size) - size, h, at, at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, c1[who], c2[who], kind, size[who], own[who])], names=["key", "c1", "c2", "kind", "n", "u"])

    return map_arrow(sets.select("c.c1", "c.c2", "u", "items"), run, "key long, c1 long, c2 long, kind long, n long, u long")


def _hub_rows(rows: DataFrame) -> DataFrame:
    """Every row of a key that more than one row has, with the hub it meets (its class, n and u);
    the hub's own row names itself."""
    def run(batches):
        for row, hub in _hubs(batches, whole=True):
            cols = [pa.array(row[f]) for f in ("key", "c1", "c2", "kind", "n", "u")] + [pa.array(hub[f]) for f in ("c1", "c2", "n", "u")]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "c1", "c2", "kind", "n", "u", "h1", "h2", "nh", "uh"])

    found = map_arrow(rows.repartition("key").sortWithinPartitions("key", "kind", "u", "c1", "c2"), run, "key long, c1 long, c2 long, kind long, n long, u long, h1 long, h2 long, nh long, uh long")
    return found.select("key", F.struct("c1", "c2").alias("c"), "kind", "n", "u", F.struct(F.col("h1").alias("c1"), F.col("h2").alias("c2")).alias("h"), "nh", "uh")


def _bounded(df: DataFrame) -> DataFrame:
    """To be broadcast if it has few rows, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _open_pairs(rows: DataFrame, label: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that meet under a key, could be linked and are in different components.

    A set shares o elements with its key's hub, u with no set and v = n-o-u with others only, so two
    sets of a key share min(o)+min(v) elements at most. Where one set lacks elements of the hub in
    a part of the universe in which the other has all of them, one more is not shared, for each such
    part. Where the tie to the hub was ruled out, o and v are n-u at most and the parts unknown."""
    root = _bounded(label.select(F.col("node").alias("c"), "root"))
    words = range(SKETCH_WORDS)
    ends = [tied.select(F.col(c).alias("c"), F.col(h).alias("h"), "both", *(F.col(f"l{c}{k}").alias(f"l{k}") for k in words)) for c, h in ("ab", "ba")]
    shared = _bounded(ends[0].union(ends[1]))
    rows = rows.join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    # a key's main component is the one with most members; only the other members look for partners
    part = rows.groupBy("key", "root").agg(F.count("*").alias("members"))
    split = part.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = rows.join(split, "key").join(shared, ["c", "h"], "left")
    rows = rows.withColumn("o", F.expr("if(c = h, n, coalesce(both, n - u))")).withColumn("v", F.expr("if(c = h, 0, coalesce(n - u - both, n - u))"))
    rows = rows.withColumn("sure", F.expr("c = h or both is not null")).withColumns({f"l{k}": F.coalesce(f"l{k}", F.lit(0)) for k in words})
    kept = {"root": "r", "kind": "k", "n": "n", "u": "u", "o": "o", "v": "v", "sure": "s"} | {f"l{k}": f"l{k}" for k in words}
    side = lambda df, s: df.select("key", F.col("c").alias(s), *(F.col(f).alias(f"{to}{s}") for f, to in kept.items()), *(["main"] if s == "b" else []))
    few, rest = side(rows.where("root <> main"), "a"), side(rows, "b")
    near = f"({NEAR_PROBE}, {NEAR})"
    open_ends = f"ra <> rb and (rb = main or a < b) and least(ka, kb) <= {NEAR_PROBE} and not (ka in {near} and kb in {near})"
    lost = lambda x, y: f"if(sa and sb, {' + '.join(f'bit_count(l{k}{y} & ~l{k}{x})' for k in words)}, 0)"
    common = f"least(oa - {lost('a', 'b')}, ob - {lost('b', 'a')})"
    room = f"{100 + percent} * ({common} + least(va, vb)) >= {percent} * (na + nb)"
    met = few.join(rest, "key").where(f"{open_ends} and {possible(percent)} and {room}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, component root of every linked class)."""
    bands = Bands(percent)
    docs = written(_documents(df, id_col, text_col, n), "classes")
    rows = _rows(df, text_col, n, bands).repartition("key").sortWithinPartitions("key", "kind")
    met = map_arrow(rows, _met, "c1 long, c2 long").distinct()
    known = docs.groupBy("c1", "c2").agg(F.min("id").alias("id"))
    wanted = written(known.join(met, ["c1", "c2"]).select("id", "c1", "c2"), "wanted")
    sets = written(_sets(df, wanted, id_col, text_col, n), "sets")
    sets = sets.join(_alone(sets), "c", "left").select("c", "n", F.coalesce("u", F.lit(0)).alias("u"), "items")
    smallest = f"ceil({percent} * n / 100)"  # the partner that leaves most room
    sets = written(sets.where(f"{100 + percent} * (n - u) >= {percent} * (n + {smallest})"), "near-sets")
    rows = written(_hub_rows(_set_rows(sets, bands)), "hub-rows")
    tie = rows.where(f"c <> h and {possible(percent, '', 'h')}").select(F.least("c", "h").alias("a"), F.greatest("c", "h").alias("b")).distinct()
    tied = written(_overlaps(tie, sets, sketch=True), "ties")
    links = tied.where(_reaches(percent)).select("a", "b")
    label = components(links)
    more = _open_pairs(rows, label, tied, percent).join(tied.select("a", "b"), ["a", "b"], "left_anti")
    more = written(more, "open-pairs")
    late = written(_overlaps(more, sets).where(_reaches(percent)).select("a", "b"), "late-links")
    return docs, label if late.isEmpty() else components(links.union(late))


def _labelled(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, hash, n, component, root) of every row; components that share their smallest id differ in root."""
    docs, label = classes(df, id_col, text_col, n, percent)
    docs = docs.withColumn("c", F.struct("c1", "c2"))
    known = docs.where("n > 0").groupBy("c").agg(F.min("id").alias("least"))
    known = known.join(label, known["c"] == label["node"], "left").select("c", "least", F.coalesce("root", "c").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    of = known.select("c", "root").join(least, "root").select("c", "root", "component")
    out = docs.join(of, "c", "left")
    return out.select("id", "hash", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"), "root")


def component_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links."""
    found = _labelled(df, id_col, text_col, n, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """``df`` with one document of each component, the one whose id is the component's (of such an
    id's texts in the component the one with the smallest hash). Texts that share an id are judged
    each by its own component. Documents with an empty set stay. Of rows that repeat a kept id with
    the same text one stays. A row
    without an id goes if its component has one; else repeats of its text go."""
    found = written(_labelled(df, id_col, text_col, n, percent), "component-ids")
    key, other, tag = F.col(id_col), fresh(df, "__id"), fresh(df, "__hash")
    own = found.where("n > 0 and id = component").select("id", "hash", "root")
    texts = own.groupBy("root").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most")
    gone = found.where("n > 0 and id <> component").select("id", "hash")
    gone = gone.union(own.join(_bounded(texts), "root").where("hash <> least").select("id", "hash")).distinct().toDF(other, tag)
    left = df.join(_bounded(gone), (key == F.col(other)) & (F.xxhash64(text_col) == F.col(tag)), "left_anti")
    again = found.where("id is not null").groupBy(F.col("id").alias(other)).agg(F.count("*").alias("rows")).where("rows > 1").select(other)
    if not again.isEmpty():
        same = key == F.col(other)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
    nameless = found.where("id is null and n > 0")
    if not nameless.isEmpty():
        out = nameless.where("component is not null").select(F.col("hash").alias(other)).distinct()
        rows = left.where(key.isNull()).join(out, F.xxhash64(text_col) == F.col(other), "left_anti")
        left = left.where(key.isNotNull()).unionByName(rows.dropDuplicates([text_col]))
    return left
