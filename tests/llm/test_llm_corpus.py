"""Passages, tokens, WARC, preference pairs, set join and the pipeline: brute force and edge cases."""

import base64
import gzip
import hashlib
import json
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from meterkit.llm import bpe, chat, decontam, jaccard, langid, lines, pii, warc
from meterkit.llm import queries as registered
from meterkit.llm.common import fresh
from meterkit.llm.components import components

SF = "/root/testdata/sf0.001"
VOCAB = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
EDGE = ["", None, " \t\n", "one", "Die die DIE", "a b c d " * 40, "same line\nsame line\nother", "é" * 3000, "x" * 30_000, "word " * 20_000, "…!?"]


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=VOCAB[1], mergeable_ranks=bpe.read_ranks(VOCAB[0]), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(VOCAB[0]), VOCAB[1])


def test_encoder_matches_the_library(encoder, reference):
    rng = random.Random(3)
    texts = ["a" * 9000, " " * 700, "ab" * 900, "é" * 333, "日本語テキスト" * 40, "0" * 99, "\n" * 50, "🙂" * 20, " \t\n mixed  x", "I'll don't <|endoftext|>", "x"]
    texts += ["".join(rng.choice("etaoinshrdlucmfw ÄßÉ.,!'\n\t0123") for _ in range(rng.randrange(150))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (60, 64, 65, 66, 200, 900)]
    for t in texts:
        pieces = encoder.pieces_of(t)
        encoder.learn(pieces)
        assert [int(x) for p in pieces for x in encoder.cache[p][1].split()] == reference.encode_ordinary(t), t[:40]
        assert b"".join(encoder.cache[p][2] for p in pieces) == t.encode()


def test_long_and_short_forms_agree(encoder):
    rng = random.Random(8)
    pieces = list({"".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 40))) for _ in range(400)})
    raw = [p.encode() for p in pieces]
    assert encoder._contract(bpe.ENCODE, raw) == encoder._contract(bpe.ENCODE_LONG, raw)


def test_cache_forgets_in_generations(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    for i in range(200):
        encoder.learn([f"piece{i}", f"piece{i - 1}"])
        assert f"piece{i}" in encoder.cache and len(encoder.cache) < 60


def test_registered_tokens(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registered.queries()["op4_byte_bpe"](spark, SF).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_encode_decode_round_trip(spark, reference):
    rows = [(i, t, 7) for i, t in enumerate(EDGE)] + [(None, "x y", 7), (None, "x y", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int")  # ids is replaced
    out = bpe.decode(bpe.encode(df, *VOCAB), *VOCAB)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    nulls = bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), *VOCAB).collect()
    assert [r.decoded for r in nulls] == [None, b""]
    assert bpe.encode(df.limit(0), *VOCAB).count() == 0


# ---- repeated passages ----


def brute_passages(rows):
    """Earliest occurrences over all rows, then runs: {row: [(start, end)]}; rows are (id, text)."""
    seen = {}
    for key in sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0)):
        for place, (a, b, unit, n) in enumerate(lines.units(key[1] or "")):
            seen.setdefault(unit, (key, place))
    out = {}
    for key in set(rows):
        spans, run = [], None
        for place, (a, b, unit, n) in enumerate(lines.units(key[1] or "")):
            if seen[unit] != (key, place):
                run = (run[0], b, run[2] + n) if run else (a, b, n)
                continue
            spans += [run] if run else []
            run = None
        spans += [run] if run else []
        out[key] = [(a, b) for a, b, n in spans if n >= lines.MIN_WORDS]
    return out


def passages():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([". ", "! ", ".\n"])
    shared = ["".join(sentence(rng.randrange(4, 15)) for _ in range(7)) for _ in range(4)]
    short = "Read the common line. "
    rows = []
    for i in range(40):
        text = "".join(sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(6)))
        if rng.random() < 0.6:
            text += rng.choice(shared)
        if rng.random() < 0.6:
            text += short
        rows.append((i, text + "".join(sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(4)))))
    rows += [(50, rows[3][1]), (None, rows[4][1]), (7, rows[7][1]), (7, rows[7][1]), (None, None), (60, ""), (61, None), (62, shared[0].upper().replace(" ", "  "))]
    return rows


def test_units_cover_the_text():
    for t in (t for t in EDGE if t):
        assert "".join(lines._UNITS.findall(t)) == t


@pytest.mark.parametrize("partitions", [1, 7])
def test_passages_match_brute_force(spark, partitions):
    rows = passages()
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id int, text string, removed string").repartition(partitions)
    want = brute_passages(rows)
    out = lines.dedup(df).collect()
    assert len(out) == len(rows)
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", str([(s.start, s.end) for s in r.removed or []])) for r in out))
    expect = []
    for key in rows:
        text = lines.without(key[1], [{"start": a, "end": b} for a, b in want[key]])
        expect.append((key[0] is None, key[0] or 0, text is None, text or "", str(want[key])))
    assert texts == sorted(expect)
    assert any(want.values()) and sum(map(bool, want.values())) < len(want)
    assert lines.dedup(df.limit(0)).count() == 0


# ---- one of near copies ----


def test_keep_one_judges_each_text_of_an_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    near = text("d") + " end"
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("b")), (2, "x"), (4, text("c")), (4, text("c")), (5, text("d")), (5, near), (6, near)]
    left = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    assert sorted(r for r in left if r[0] != 5) == sorted([(1, text("a")), (2, text("b")), (2, "x"), (4, text("c"))])
    assert [r[1] in (text("d"), near) for r in left if r[0] == 5] == [True]


# ---- preference pairs ----


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "A"), (1, 2, "user", "Q"), (1, 3, "assistant", "R1")]
    turns += [(2, 0, "user", "Hi"), (2, 1, "assistant", "A"), (2, 2, "user", "Q"), (2, 3, "assistant", "R2 é"), (2, 4, None, None)]
    turns += [(3, 0, "user", "Hi"), (4, None, None, None), (4, 0, "user", "x"), (4, 0, "user", "x"), (5, None, None, None), (None, 0, "user", "Hi")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id int, turn int, role string, text string, turns string")
    convs = chat.conversations(df)
    got = {r.chosen_id: r for r in chat.preference_examples(chat.pairs_by_first_turn(convs), convs).collect()}
    assert set(got) == {1, 3, 4}
    one = got[1]
    assert one.rejected_id == 2 and one.n_prompt_turns == 3
    assert one.prompt == "<|user|>\nHi<|end|>\n<|assistant|>\nA<|end|>\n<|user|>\nQ<|end|>\n"
    assert one.chosen == "<|assistant|>\nR1<|end|>\n" and one.chosen_mask == "14:0,10:1"
    assert one.rejected == "<|assistant|>\nR2 é<|end|>\n<|unknown|>\n<|end|>\n" and one.rejected_mask == "14:0,12:1,20:0"
    assert sum(int(x.split(":")[0]) for x in one.rejected_mask.split(",")) == len(one.rejected)
    assert got[3].rejected_id is None and got[3].prompt == "" and got[3].rejected is None and got[3].chosen == "<|user|>\nHi<|end|>\n"
    assert got[4].rejected_id == 5 and got[4].n_prompt_turns == 1 and got[4].rejected == "" and got[4].chosen.count("x") == 2
    same = spark.createDataFrame([(1, 1)], "chosen_id int, rejected_id int")
    r = chat.preference_examples(same, convs).first()
    assert r.n_prompt_turns == 4 and r.chosen == "" and r.rejected == "" and r.chosen_mask == ""
    none = chat.conversations(df.limit(0))
    assert chat.preference_examples(chat.pairs_by_first_turn(none), none).count() == 0


def test_every_conversation_is_in_one_pair(spark):
    rows = [(i, 0, "user", "same" if i % 3 else f"own{i}") for i in range(-50, 900)]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    pairs = chat.pairs_by_first_turn(convs).collect()
    ids = [x for r in pairs for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(ids) == list(range(-50, 900))
    assert sum(r.rejected_id is None for r in pairs) == sum(i % 3 == 0 for i in range(-50, 900)) + sum(i % 3 != 0 for i in range(-50, 900)) % 2


def test_text_conversation_ids(spark):
    rows = [(c, 0, "user", "hi") for c in "abc"] + [(c, 1, "assistant", c) for c in "abc"]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    pairs = chat.pairs_by_first_turn(convs).collect()
    assert sorted(x for p in pairs for x in (p.chosen_id, p.rejected_id) if x) == ["a", "b", "c"] and len(pairs) == 2


def test_chat_plan_is_native(spark):
    convs = chat.conversations(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = chat.preference_examples(chat.pairs_by_first_turn(convs), convs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- WARC ----


def test_malformed_warc_headers():
    good = warc.record("response", "urn:x\r\nEvil: 1", "2025\r\nEvil: 2", "http://a/", "text/plain", b"body", [])
    (head, body), = warc.parse(good)
    assert body == b"body" and "evil" not in head
    for wrong in (b"abc", b"-5", b"", "²".encode()):
        broken = good.replace(b"Content-Length: 4", b"Content-Length: " + wrong)
        got = warc.parse(broken + good)
        assert [b for _, b in got] == [b"body", b"body"], wrong
    assert [b for _, b in warc.parse(good.replace(b"Content-Length: 4", b"X: 4"))] == [b"body\r\n\r\n"]


def test_warc_derivatives_are_linked(spark, tmp_path):
    rows = [(1, "http://a.example/é x", "<html><title>T &amp;\n U</title><body><p>Hello <b>w</b>orld</p><p>two\r\n\r\nlines</p></body>"), (2, None, None), (None, "u", ""), (3, "v\nw", "plain"), (3, "v\nw", "plain")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, record_id string")
    src = warc.responses(pages)
    made = warc.derivatives(src, keep=["page_id"]).collect()
    assert len(made) == 2 * len(rows) and len({r.record_id for r in made}) == 2 * (len(rows) - 1)
    sources = {r.record_id: r for r in src.collect()}
    for r in made:
        (head, body), = warc.parse(bytes(r.record))
        source = sources[r.response_id]
        assert head["warc-type"] == r.record_type and head["warc-refers-to"] == f"<{r.response_id}>" and head["warc-date"] == source.date
        assert uuid.UUID(r.record_id.removeprefix("urn:uuid:")).version == 5
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() == head["warc-block-digest"]
        assert r.content_length == len(body) == int(head["content-length"])
        assert ("warc-target-uri" in head) == (source.target_uri is not None)
        if r.record_type == "metadata":
            fields = dict(x.split(": ", 1) for x in body.decode().strip().split("\r\n") if ": " in x)
            assert fields["source-header-content-type"] == "text/html; charset=utf-8" and fields["source-block-digest"] == warc.digest(bytes(source.block))
            assert any(o.record_id == fields["conversion"].strip("<>") and o.response_id == r.response_id for o in made)
            assert r.page_id != 1 or fields["title"] == "T & U"
        elif r.page_id == 1:
            assert body.decode() == "Hello world\ntwo lines"
    path = str(tmp_path / "w")
    warc.write_records(warc.response_records(src), path, "gzip")
    back = warc.read_responses(spark, f"{path}/part*")
    fix = lambda df: sorted((r.record_id, r.target_uri and " ".join(r.target_uri.split()), r.date, bytes(r.block)) for r in df.collect())
    assert [x[0] for x in fix(back)] == [x[0] for x in fix(src)] and [x[3] for x in fix(back)] == [x[3] for x in fix(src)]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_encodings_and_headers_of_real_files(spark, tmp_path):
    page = "<html><title>T é</title><body><p>Hello world</p></body>".encode()
    raw = zlib.compressobj(wbits=-15)
    sent = {"gzip": gzip.compress(page[:20]) + gzip.compress(page[20:]), "deflate": zlib.compress(page), "Deflate": raw.compress(page) + raw.flush(), "identity": page}
    chunked = lambda b: b"".join(b"%x;e=1\r\n%b\r\n" % (len(b[i : i + 7]), b[i : i + 7]) for i in range(0, len(b), 7)) + b"0\r\n\r\n"
    cases = [(k, "chunked" if c else "", chunked(b) if c else b) for k, b in sent.items() for c in (False, True)]
    cases += [("gzip", "chunked", page), ("br", "", page)]  # undone already by the crawler
    more = [("WARC-Payload-Digest", "sha1:STATED"), ("WARC-IP-Address", "192.0.2.1"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    with open(tmp_path / "real.warc", "wb") as f:
        for i, (encoding, transfer, body) in enumerate(cases):
            head = f"HTTP/1.1 200 OK\r\nContent-Encoding: {encoding}\r\n" + (f"Transfer-Encoding: {transfer}\r\n" if transfer else "") + "\r\n"
            f.write(warc.record("response", f"urn:r{i}", warc.DATE, "u", "application/http; msgtype=response", head.encode() + body, more))
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path / "real.warc"))).collect()
    assert len(made) == 2 * len(cases)
    for r in made:
        (_, body), = warc.parse(bytes(r.record))
        if r.record_type == "conversion":
            assert body.decode() == "Hello world", r.response_id
        else:
            fields = [tuple(x.split(": ", 1)) for x in body.decode().split("\r\n") if ": " in x]
            assert ("title", "T é") in fields and {(f"source-{k.lower()}", v) for k, v in more} <= set(fields)
    assert warc.content([("Content-Encoding", "br")], b"\x8b\xff\x00") == b"" and warc.inflated(gzip.compress(b""), (31,)) == b"" and warc.unchunked(b"5\r\nab") == b"ab"
    assert "record" in registered.queries()["op6_warc_derivatives"](spark, SF).columns


# ---- set join ----


def brute_components(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                root[find(a)] = find(b)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), key if not sets[i] else min(ids, default=None)))
    return out


def copies(seed, sizes, edits):
    """Families of edited copies, chains of copies, and short texts of one vocabulary."""
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        last = base
        for _ in range(12):
            words = list(rng.choice([base, last]))
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(words))
                words[at : at + 1] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1, 1, 1, 2])
                if not words:
                    words = ["z"]
            last = words
            rows.append(" ".join(words))
    rows += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows, start=100))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(spark, seed):
    rows = copies(seed, [5, 8, 12, 20, 33, 50, 80, 140, 260], 9)
    rows += [(1, rows[5][1]), (None, rows[6][1]), (None, "lonely null words here now"), (None, None), (2, ""), (rows[7][0], rows[7][1]), (3, rows[8][1].upper())]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id int, text string, n int").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_ids(df).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


@pytest.mark.parametrize("percent,n", [(80, 5), (60, 3), (95, 1)])
def test_other_thresholds(spark, percent, n):
    rows = copies(7, [6, 15, 40, 90, 150], 14)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_ids(df, n=n, percent=percent).collect())
    assert got == sorted(brute_components(rows, n, percent))


def test_every_allocation_meets_linked_pairs():
    """Pairs of sets within the bound meet under a key, whatever the costs around them are."""
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(85)
    for size in [6, 7, 10, 11, 16, 17, 30, 60, 90, 200]:
        for _ in range(30):
            a = rng.integers(0, 2**62, size).astype(np.uint64)
            other = int(rng.integers(size, bands.partner(size) + 1))
            most = int(bands.differ(size, other))
            drop = (most - (other - size)) // 2
            b = np.concatenate([a[drop:], rng.integers(0, 2**62, other - size + drop).astype(np.uint64)])
            if 185 * (size - drop) < 85 * (size + other):
                continue
            noise = [rng.integers(0, 2**62, size).astype(np.uint64) for _ in range(3)] + [a[:-1]] * 3
            sides = []
            for s in (a, b):
                sets = [s, *noise]
                n = np.array([len(x) for x in sets])
                key, who, _, kind = jaccard.block_rows(bands, n, np.cumsum(n) - n, np.concatenate(sets), np.arange(len(n)), np.arange(len(n)))
                mine = who == 0
                sides.append({(k, t) for k, t in zip(key[mine].tolist(), kind[mine].tolist())})
            x, y = sides
            near = (jaccard.NEAR_PROBE, jaccard.NEAR)
            assert any(k == q and min(t, r) <= jaccard.NEAR_PROBE and not (t in near and r in near) for k, t in x for q, r in y), (size, other)


def test_block_ties_keep_every_member():
    n = 50
    rng = np.random.default_rng(1)
    key = np.repeat([5, 6, 7], [n, 2, 10])
    c1 = rng.integers(0, 99, len(key))
    kind = np.where(key == 7, jaccard.EXACT, jaccard.EXACT_PROBE)
    out = jaccard.tie_block(key, c1, c1, kind)
    assert set(out[1].tolist()) == set(c1.tolist())
    assert (out[0] == 5).sum() == 1 and (out[0] == 6).sum() == len(set(c1[n : n + 2].tolist()))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[300] != got[0] and len(got) == 64
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_keep_one(spark):
    rows = copies(5, [30, 60], 3)
    rows += [(1, rows[0][1]), (1, rows[0][1]), (2, ""), (2, ""), (None, None), (3, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, __id string, component_id int")
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    want = {i for i, n, c in brute_components(rows) if n and i == c}
    kept = [r.doc_id for r in got.collect()]
    assert sorted(i for i in kept if i not in (None, 2, 3)) == sorted(want)
    assert kept.count(1) == 1 and kept.count(None) == 1 and 2 in kept and 3 in kept
    assert jaccard.keep_one(df.limit(0)).count() == 0
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    mixed = [(5, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (None, ""), (None, None), (6, None)]
    rows = jaccard.keep_one(spark.createDataFrame(mixed, "doc_id int, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in rows if r.text) == [(0, "b0"), (5, "a0")] and any(r.doc_id == 6 for r in rows)


# ---- the pipeline ----


def test_stages_against_their_own_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("`odd.name`", F.lit("x"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_duplicates", "benchmark_overlap", "personal_data", "tokens"]
    first = stage["language"](spark, docs, SF)
    assert first.columns == docs.columns
    model = langid.train(docs)
    rows = docs.collect()
    lang, score = langid.predict_texts(model, [r.text for r in rows])
    keep = {r.doc_id for r, a, s in zip(rows, lang, score) if a != "und" and s >= langid.MIN_SCORE}
    first = spark.createDataFrame(first.collect(), docs.schema)
    assert {r.doc_id for r in first.collect()} == keep and len(keep) > 0.95 * len(rows)
    second = stage["near_duplicates"](spark, first, SF)
    want = {i for i, n, c in brute_components([(r.doc_id, r.text) for r in first.collect()], 5, 80) if not n or i == c}
    second = spark.createDataFrame(second.collect(), docs.schema)
    assert {r.doc_id for r in second.collect()} == want
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    third = stage["benchmark_overlap"](spark, second, SF)
    dirty = {r.doc_id for r in decontam.contamination(second, bench).where("contaminated").collect()}
    third = spark.createDataFrame(third.collect(), docs.schema)
    assert {r.doc_id for r in third.collect()} == want - dirty and dirty
    fourth = stage["personal_data"](spark, third, SF)
    field = pii.train()
    for r in fourth.collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        assert r.text == pii.redacted(text, pii.all_spans(field, [text])[0][1]) and r.n_chars == len(r.text)
        assert pii.base_spans(r.text) == []
    last = stage["tokens"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == want - dirty and all(r.decoded_sha256 for r in last)


def test_stages_on_hard_rows(spark):
    rows = [(i, t, None if i % 3 else "en", "s", None) for i, t in enumerate([*EDGE, *EDGE])] + [(None, "A text in words without an id. " * 5, "en", None, 4)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.count() == docs.count()


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([], "a int, __ID int, ___id int"), "__id") == "____id"


def test_pipeline_module_is_plain():
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in registered.queries() and "pipeline" not in registered.oracle_sql()
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


# ---- what workers keep ----


def test_an_operator_drops_what_another_kept():
    from meterkit.llm import common

    closed = []

    class Thing:
        def close(self):
            closed.append(1)

    common.drop_state()
    first = common.kept_state("a", Thing)
    assert common.kept_state("a", Thing) is first and not closed
    common.drop_state("a")
    assert common.kept_state("a", Thing) is first
    assert common.kept_state("b", Thing) is not first and closed == [1] and list(common._KEPT) == ["b"]
    common.drop_state()
    assert not common._KEPT and closed == [1, 1]
