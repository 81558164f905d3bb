"""Ranked search, collocations and fingerprints: brute force in plain Python and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from meterkit.llm import collocations as col
from meterkit.llm import rank, spots
from meterkit.llm import queries as registered

SF = "/root/testdata/sf0.001"
EDGE = ["", None, " \t\n", "...", "one", "Die die DIE", "the the the the", "a b c d " * 40, "same line\nsame line\nother", "é" * 3000, "x" * 1_000_000, "word " * 200_000, "…!?", "İstanbul straße"]
TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(low(text))


# ---- ranked search ----


def brute_search(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = Counter()
    for item, text in set(items):
        found = []
        for i, bag, n in bags:
            if n:
                m = 25 + (75 * n * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
                if score > 0:
                    found.append((-score, i is None, i if i is not None else 0, i))
        for r, (s, *_, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out[item, r, i, -s] += 1
    return out


def search_rows():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta Gamma delta eins zwei drei été ñu x1 the of and".split())
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    docs += [(200 + i, docs[3][1]) for i in range(60)]  # a class larger than the result
    docs += [(7, docs[7][1]), (7, "beta beta"), (None, docs[3][1]), (None, "Gamma!")]
    docs += [(400 + i, t) for i, t in enumerate(EDGE)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(25)]
    items += [(1, items[1][1]), (1, "drei DREI"), (90, None), (91, "nothing here known"), (None, "été"), (92, "one die x1 " * 50)]
    return docs, items


@pytest.mark.parametrize("partitions,bytes_,block", [(1, rank.BROADCAST_BYTES, 256), (5, 0, 4), (13, rank.BROADCAST_BYTES, 3)])
def test_search_matches_brute_force(spark, monkeypatch, partitions, bytes_, block):
    monkeypatch.setattr(rank, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(rank, "ITEM_BLOCK", block)
    docs, items = search_rows()
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, item_id string, score double").repartition(partitions)
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    got = rank.search(df, asked, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 10)


def test_search_of_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r["rank"], r.doc_id) for r in rank.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert rank.search(docs.limit(0), items).count() == 0 and rank.search(docs, items.limit(0)).count() == 0


def test_terms_are_the_stated_pattern():
    for t in [x for x in EDGE if x] + ["A-b_c's 12,5 naïve x y"]:
        assert [w.decode() for w in rank.terms_of(t)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))


# ---- collocations ----


def brute_collocations(rows, least, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in cand.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                inside[lang, p[i : i + n]] = max(inside[lang, p[i : i + n]], a)
    out = []
    for lang in total:
        rows = []
        for (of, p), a in cand.items():
            if of == lang and not 100 * inside[of, p] >= 100 * a:
                cuts = [((1000 * a * total[lang]) // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
        out += [(lang, i, p, -a, x, y, total[lang], -s) for i, (s, a, _, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


def phrase_rows():
    rng = random.Random(9)
    word = lambda: rng.choice("a b c d e f New York très grand Zeit und".split())
    rows = []
    for i in range(150):
        text = "".join(" ".join(word() for _ in range(rng.randrange(1, 25))) + rng.choice([". ", ", ", "\n", " ! ", "\t"]) for _ in range(6))
        rows.append((rng.choice(["en", "de", None]), text + "one two three four five six seven. " * (i % 3)))
    rows += [("en", rows[0][1])] * 5 + [("xx", t) for t in EDGE if t is None or len(t) < 10_000] + [("long", "tick tock " * 20_000)]
    return rows


@pytest.mark.parametrize("partitions,bytes_", [(1, col.BROADCAST_BYTES), (6, 0)])
def test_collocations_match_brute_force(spark, monkeypatch, partitions, bytes_):
    monkeypatch.setattr(col, "BROADCAST_BYTES", bytes_)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, text string, n int, phrase string").repartition(partitions)
    got = col.collocations(df, least=20, top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_collocations(rows, 20, 30))


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert col.collocations(df).count() == 0 and col.collocations(df.limit(0)).count() == 0


def test_chunks_cover_every_phrase_once():
    rng = random.Random(2)
    lists = [[rng.choice("abcdefgh") for _ in range(n)] for n in (1, 3, 4, 5, 40, 400, 0, 700)] + [["x"] * 300]
    texts = [lists[:3], lists[3:5], lists[5:6], lists[6:]]  # rows are pieces, some texts have several
    rows = ["".join(rng.choice([" ", "  ", "\t "]).join(x) + rng.choice(["\n", " \n\n"]) for x in t) for t in texts]
    words = col.Words("".join(rows).encode())
    start, stop, owned = col.parse(words, np.searchsorted(np.cumsum([len(r) for r in rows]), words.at, side="right"))
    got = Counter()
    for chunk, own in zip(words.texts(start, stop).to_pylist(), owned):
        before = 0
        for piece in chunk.split("\n"):
            ws = piece.split(" ")
            for i in range(min(len(ws), own - before)):
                got.update(tuple(ws[i : i + n]) for n in range(1, col.MOST_WORDS + 1) if i + n <= len(ws))
            before += len(ws)
    assert got == Counter(tuple(x[i : i + n]) for x in lists for n in range(1, 6) for i in range(len(x) - n + 1))
    assert len(start) > len(lists)  # long lists are cut


def test_groups_compare_bytes():
    words = col.Words(b"ab cd\nab cd\nef gh\n")
    a = np.array([0, 2, 4])
    for h in ([1, 1, 2], [1, 1, 1]):  # the second: one hash for all
        order, lead = words.groups(a, a + 2, np.array(h, np.uint64), np.zeros(3, np.int64))
        assert sorted(len(x) for x in np.split(order, lead[1:])) == [1, 2]
        assert {0, 1} in [set(x.tolist()) for x in np.split(order, lead[1:])]


def test_long_texts_are_cut_after_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(col, "BLOCK", 50)
    texts = ["a b. " * 30, "", "x" * 120, "c d " * 40 + ", e", None, "f"]
    batch = pa.RecordBatch.from_pydict({"lang": [str(i) for i in range(len(texts))], "text": texts})
    parts = list(col._parts([batch]))
    assert len(parts) > 4
    got = Counter()
    for raw, langs, ends in parts:
        words = col.Words(raw)
        lang = np.array(langs, dtype=object)[np.searchsorted(ends, words.at, side="right")]
        got.update(zip(lang.tolist(), words.texts(np.arange(len(lang)), np.arange(len(lang)) + 1).to_pylist()))
    assert got == Counter((str(i), w) for i, t in enumerate(texts) for w in re.findall(r"[^\s.,]+", t or ""))


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and a tie of cuts that goes to the shortest first part."""
    big = 3_037_000_499_123
    phrases = spark.createDataFrame([("x", "a b c", 3, big - 7), ("x", "a", 1, big), ("x", "b c", 2, big + 1), ("x", "a b", 2, big), ("x", "c", 1, big + 1), ("x", "b", 1, big + 9)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("x", 9_000_000_000_000_011)], "lang string, n long")
    got = {r.phrase: (r.l, r.r, r.score) for r in col.scores(phrases, totals).collect()}
    assert got["a b c"] == (big, big + 1, (1000 * (big - 7) * 9_000_000_000_000_011) // (big * (big + 1)))


# ---- fingerprints ----


def brute_signatures(text):
    words = terms(text)
    content = [w for w in words if w.encode() not in spots.ANCHORS]
    found, seen = set(), 0
    for w in words:
        anchor = w.encode() in spots.ANCHORS
        seen += not anchor
        if (anchor or hashlib.md5(w.encode()).hexdigest()[0] == "0") and content[seen:]:
            found.add(":".join([w, *content[seen : seen + 2]]))
    if words:
        found.add("^:" + ":".join(words[:2]))
    return {hashlib.md5(s.encode()).hexdigest()[:16] for s in found}


def brute_edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, other = brute_signatures(text), brute_signatures(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(own)), "".join(sorted(other)), alike(own, other), alike(own, brute_signatures(after)), len(own)))
    return out


def print_rows():
    docs = [(i, t) for i, t in search_rows()[0] if i is not None and i < 400 and i != 7]
    return docs + [(-3 - i, t) for i, t in enumerate(EDGE)] + [(None, "alone the end")]


@pytest.mark.parametrize("partitions,rows_", [(1, 2048), (4, 8)])
def test_fingerprints_match_brute_force(spark, monkeypatch, partitions, rows_):
    monkeypatch.setattr(spots, "PART_ROWS", rows_)
    rows = print_rows()
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, fingerprint string, part int").repartition(partitions)
    got = spots.edited_likeness(df)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_edited(rows), key=key)
    plain = {r.doc_id: r.fingerprint for r in spots.fingerprints(df).collect()}
    assert plain == {d: "".join(sorted(brute_signatures(t))) for d, t in rows}


def test_repeated_rows_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(spots, "PART_ROWS", 5)
    a, b = "the alpha beta gamma und so weiter", "der kleine hund ist hier und dort"
    df = spark.createDataFrame([(5, a)] * 40 + [(3, b)], "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.near_next, r.edited_sha256) for r in spots.edited_likeness(df).collect())
    sha = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    assert got == Counter({(5, 1.0, sha(a, a)): 39, (5, 0.0, sha(a, b)): 1, (3, 0.0, sha(b, a)): 1})


def test_fingerprints_of_few_rows(spark):
    one = spark.createDataFrame([("id", "the quick brown fox")], "doc_id string, text string")
    assert [(r.near_next, r.doc_id) for r in spots.edited_likeness(one).collect()] == [(1.0, "id")]
    assert spots.edited_likeness(one.limit(0)).count() == 0


def test_pruned_likeness_keeps_what_reaches_the_least(spark):
    rng = random.Random(4)
    sets = [sorted({f"{rng.randrange(60):016x}" for _ in range(rng.randrange(0, 50))}) for _ in range(80)]
    for a in sets:
        for b in sets:
            exact = spots.likeness(a, b)
            for least in (0.2, 0.5, 0.8):
                assert spots.likeness(a, b, least) == (exact if exact >= least else 0.0)
    prints = spark.createDataFrame([(i, len(s), "".join(s)) for i, s in enumerate(sets)], "doc_id int, n_signatures long, fingerprint string")
    pairs = spark.createDataFrame([(i, (7 * i) % 80) for i in range(80)], "a int, b int")
    for r in spots.compare(prints, pairs, 0.5).collect():
        assert r.likeness == spots.likeness(sets[r.a], sets[r.b], 0.5)


# ---- the registered queries' SQL ----


def test_search_queries_match_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    from check_oracle import compare

    names = ["op11_ranked_search", "op12_collocations", "op13_fingerprints"]
    assert set(names) <= set(registered.queries()) and set(names) <= set(registered.oracle_sql())
    res = compare(spark, SF, names, verbose=False)
    assert all(v[0] == "ok" for v in res.values()), res


def test_phrases_are_shuffled_without_hashes(spark):
    """Counts leave a block as (key, f): hashes, which do not compress, are made of the phrases that
    are left, and a language may hold any character."""
    import pyarrow as pa

    block = pa.RecordBatch.from_pydict({"lang": ["a\nb", "und"], "chunk": ["x y\nx", "x y"], "owned": [3, 2], "times": [2, 1], "number": [0, 1]})
    out = pa.Table.from_batches(col._counts(1)([block]))
    assert out.schema.names == ["key", "f"]
    assert sorted(zip(*out.to_pydict().values())) == [("x\na\nb", 4), ("x\nund", 1), ("y\na\nb", 2), ("y\nund", 1)]
    chunks = spark.createDataFrame([tuple(r.values()) for r in block.to_pylist()], "lang string, chunk string, owned long, times long, number long")
    got = col.frequent(chunks, 1, None, 2).collect()
    b = col._Block(block)
    hashes = dict(zip([("a\nb", "x"), ("a\nb", "y"), ("a\nb", "x"), ("und", "x"), ("und", "y")], b.hashes(b.starts(1), 1)))
    assert sorted((r.lang, r.phrase, r.f, r.hash) for r in got) == [("a\nb", "x", 4, hashes["a\nb", "x"]), ("a\nb", "y", 2, hashes["a\nb", "y"])]
