"""Quality rules, HTML, language labels, decontamination, personal data: brute force and edge cases."""

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterkit.llm import decontam, htmltext, langid, oracle, pii, quality
from meterkit.llm import queries as registered

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, score double, `a.b` string, __lang string"
EDGE = ["", None, " \t\n", "one", "Die die DIE", "a b c d " * 40, "same line\nsame line\nother", "é" * 3000, "x" * 50_000, "word " * 20_000, "  ", "1 2 3", "…!?"]


def edge_rows():
    rows = [(i, t, "en" if i % 2 else None, "s", None, 1, 0.5, "x", "y") for i, t in enumerate(EDGE)]
    return [*rows, rows[5], rows[5], (None, "a b c d " * 40, "en", None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hit = set()
    three = grams(3)
    for i, g in enumerate(three):
        if three.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts_match_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "c", "dé", "#x", "\n", "e"]) for _ in range(rng.randrange(120))) for _ in range(60)] + [t for t in EDGE if t is None or len(t) < 2000]
    got = quality._signals([t or "" for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == brute_quality(t), t


def test_quality_verdict_and_edges(spark, edge, empty):
    rows = quality.quality_signals(edge).collect()
    assert len(rows) == len(edge_rows()) and sum(r.doc_id is None for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[5].base_failed  # one phrase over and over
    assert quality.quality_signals(empty).count() == 0
    prose = " ".join(f"w{i}" for i in range(400))
    repeated = prose + "\n" + "\n".join([" ".join(f"v{i}" for i in range(60))] * 3)
    two = quality.quality_signals(spark.createDataFrame([(1, prose), (2, repeated)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert two[0].kept and not two[0].base_failed
    assert not two[1].kept and not two[1].base_failed and two[1].n_dup_lines == 2


def test_hash_collision_falls_back_to_words():
    ids = np.array([0, 1, 2, 0, 1, 2, 5, 6, 7])
    at = np.arange(7)
    keys = np.zeros(7, np.uint64)  # every trigram under one hash
    pos, later, size = quality._repeats(ids, keys, at, 3)
    assert sorted(pos.tolist()) == [0, 3] and size.tolist() == [2, 2] and pos[later].tolist() == [3]


@pytest.mark.parametrize("name", ["op1_repetition", "op8_decontamination", "op3_repeated_passages", "op7_preference_format", "op9_ngram_jaccard"])
def test_registered_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registered.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = registered.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want


# ---- html ----


class _Article(HTMLParser):
    """The text inside <article>, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag not in ("b",):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if self.depth and tag not in ("b",):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_main_text_is_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = registered.queries()["op2_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        p = _Article()
        p.feed(pages[r.page_id])
        p.close()
        assert r.text == " ".join("".join(p.parts).split()) and r.n_chars == len(r.text)


def test_main_text_of_hard_pages():
    tree = htmltext.train()
    body = " ".join(f"word{i}" for i in range(40))
    one = lambda page: htmltext.main_texts(tree, [page])[0]
    assert one("") == "" and one("<") == "<" or one("<") == ""
    assert one(f"<nav><a href=x>Home</a></nav><article><p>{body} &amp; x&nbsp;y<br>z</p></article><footer>c</footer>") == f"{body} & x y z"
    assert one(f"<article><p>{body}<script>if (a<b) x='</p>'</script></p><p>{body}</article>") == f"{body} {body}"
    assert one(f"<main><h1>T</h1><p>{body}</p></main><div class='comments'><p>{body}</p></div><div id=sidebar>{body}</div>") == f"T {body}"
    assert one(f"<article><p>{body}</p><form><p>Name</p><input></form><aside>{body}</aside><!-- {body} --></article>") == body
    assert one(f"<article><p>{body}</p><p>cut o") == f"{body} cut o"
    assert one("<div class=cookie-notice>We use cookies</div>") == ""
    long = "<article>" + "<p>a b c</p>" * 20_000 + "</article>"
    assert len(one(long)) == 20_000 * 6 - 1


@pytest.mark.parametrize("head", ["<body class='single right-sidebar'>", "<html class=no-sidebar><body id=menu role=search>", "<div class='page has-sidebar'>", "<div id=with-menu><div>", "<form id=aspnetForm><div>", "<div role=form>", "<div class=comments-open>"])
@pytest.mark.parametrize("name", ["article", "article class='post comments-open'", "main class=page-header-image", "div role=main"])
def test_main_text_inside_named_wrappers(head, name):
    tree = htmltext.train()
    body = " ".join(f"word{i}" for i in range(40))
    page = f"{head}<nav><a>Home</a></nav><{name}><h1>T</h1><p>{body}</p><div class=share>{body}</div><form><p>{body}</p></form></{name.split()[0]}>"
    page += f"<div class=right-sidebar><p>{body}</p></div><div class=comments><article><p>{body}</p></article></div><aside><article><p>{body}</p></article></aside>"
    assert htmltext.main_texts(tree, [page]) == [f"T {body}"]
    assert htmltext.main_texts(tree, [f"{head}<{name}><p>{body}"]) == [body]


def test_extract_edges(spark):
    rows = [(1, "u", None, "mine"), (2, None, "", "mine"), (None, "u", "<article><p>Hello there.</p></article>", None)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string")).collect()
    assert [(r.page_id, r.text) for r in out] == [(1, ""), (2, ""), (None, "Hello there.")]
    assert htmltext.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0


# ---- language ----


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = langid._init(rng, 3, 4)
    windows = rng.integers(0, 5, (6, langid.WINDOW)).astype(np.int16)
    windows[0, 20:] = langid.PAD
    target = rng.integers(0, 3, 6)
    loss, g = langid._gradients(p, windows, target)
    for key in p:
        flat = np.abs(g[key]).ravel().argmax()
        at = np.unravel_index(flat, p[key].shape)
        losses = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[key][at] += step
            losses.append(langid._gradients(q, windows, target)[0])
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(g[key][at]), rel=0.05, abs=1e-4), key


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = registered.queries()["op5_language_id"](spark, SF).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.95


def test_language_edges(spark, edge, empty):
    model = langid.train(edge)
    assert model["langs"] == ["en"]
    out = langid.predict(edge, model).collect()
    assert len(out) == len(edge_rows())
    for r in out:
        assert (r.lang_pred == "und") == (not r.text or not re.search(r"[^\W\d_]", r.text)), r.text
        assert r.lang_pred != "und" or r.score == 0
    none = langid.train(empty)
    assert none["langs"] == [] and {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    with_old = langid.predict(edge.withColumn("lang_pred", F.lit("old")), model)
    assert with_old.columns.count("lang_pred") == 1 and "old" not in {r.lang_pred for r in with_old.collect()}


def test_document_pools_all_windows():
    model = langid.fit([("aa", b"abab abab " * 6), ("zz", b"yzyz yzyz " * 6)], steps=60)
    tail = "abab " * 20 + "yzyz " * 400  # the end decides, however far it is
    assert langid.predict_texts(model, [tail, tail[:60]])[0] == ["zz", "aa"]


# ---- decontamination ----


def brute_contamination(text, items):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[s : s + n]:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def bench_rows():
    base = [f"b{i}" for i in range(40)]
    return [(1, " ".join(base)), (2, "Tiny, ITEM"), (2, "tiny item"), (10, " ".join(base[5:20])), (None, "lone words here"), (3, None), (4, ""), (5, "x x x x x x x x x x x x x x x")]


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        words = [rng.choice(["tiny", "item", "x", "lone", "words", "here", "z", *base]) for _ in range(rng.randrange(60))]
        at, cut = rng.randrange(len(words) + 1), rng.randrange(25)
        words[at:at] = base[cut : cut + rng.randrange(30)]
        texts.append(rng.choice([" ", "-", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += ["x " * 300, None, "", "tiny", *(t for t in EDGE if t is None or len(t) < 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(bench_rows(), "item_id int, text string")
    for limit in (decontam.BENCH_BYTES, 40):  # one block, and several
        old, decontam.BENCH_BYTES = decontam.BENCH_BYTES, limit
        decontam.benchmark_blocks.__defaults__ = (*decontam.benchmark_blocks.__defaults__[:2], limit)
        for r in decontam.contamination(docs, bench).collect():
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute_contamination(texts[r.doc_id], bench_rows()), texts[r.doc_id]
            assert r.n_items == len(r["items"])
        decontam.BENCH_BYTES = old
        decontam.benchmark_blocks.__defaults__ = (*decontam.benchmark_blocks.__defaults__[:2], old)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, 300)
    tokens[-20:] = 0
    order = decontam.suffix_array(tokens, 20)
    assert sorted(order) == np.flatnonzero(tokens).tolist()

    def key(i):
        end = i + np.flatnonzero(tokens[i:] == 0)[0]
        return tokens[i:end].tolist()[:20]

    keys = [key(i) for i in order]
    assert keys == sorted(keys)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "q b0 b1 b2 q"), (2, "b0 b1 b2 b3 b4 zz"), (3, "b3 b4 b5 b6"), (4, None)], "doc_id int, text string")
    bench = spark.createDataFrame([(7, " ".join(f"b{i}" for i in range(8)))], "item_id int, text string")
    got = {r.item_word: (r.length, r.doc_id, r.doc_word) for r in decontam.longest_matches(docs, bench).collect()}
    assert got[0] == (5, 2, 0) and got[3] == (4, 3, 0) and got[1] == (4, 2, 1) and got[6] == (1, 3, 3) and 7 not in got


def test_decontaminate_keeps_rows_whole(spark, edge, empty):
    bench = spark.createDataFrame([(1, "a b c d a b c d a b c d a b c d")], "item_id int, text string")
    kept = decontam.decontaminate(edge, bench)
    assert kept.columns == edge.columns
    gone = [r for r in edge_rows() if r[1] and r[1].startswith("a b c d")]
    assert kept.count() == len(edge_rows()) - len(gone)
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.decontaminate(edge, none).count() == len(edge_rows())
    assert decontam.contamination(empty, bench).count() == 0


# ---- personal data ----

_BRUTE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(text):
    out = []
    for kind, pattern in _BRUTE.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)
            if kind == "card" and 12 <= len(digits) <= 19:
                ok = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_the_patterns():
    rng = random.Random(9)
    parts = ["a", "b@c.d", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.4", "4539 5787 6362 1486", "4539578763621486", "+1 (415) 555-2671", "+", "-", " ", "12", "é", "x@y", "\n", "55", "%", "1.2.3.4.5.6.7.8.9"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert sorted(pii.base_spans(text), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == brute_base(text), text
    long = "1" * 200_000
    assert pii.base_spans(long + "." + long) == []


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_held_out_rows(field):
    wrong = 0
    rows = pii.labelled_rows(5, seed=1234)
    for text, spans in rows:
        want = [(k, a, b) for k, a, b in spans]
        got = pii.field_spans(field, [text])[0]
        wrong += [k for k, _, _ in got] != [k for k, _, _ in want] or any(a > c or d > b for (_, a, b), (_, c, d) in zip(want, got))
    assert wrong / len(rows) < 0.02


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    field = pii.Field({}, np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    length = np.array([3, 1, 2, 3])
    e = rng.normal(size=(int(length.sum()), k))
    got = pii.viterbi(field, e, length)
    at = 0
    for n in length:
        best = max(np.ndindex(*([k] * n)), key=lambda p: field.first[p[0]] + sum(e[at + i][x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])))
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_field_adds_and_never_removes(field):
    text = 'see token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or a.b@c.org, éé 97.51.17.173 on 2024-01-02; 2 of 3, v1.2.3'
    (base, every), (none, nothing) = pii.all_spans(field, [text, ""])
    assert base == brute_base(text) and set(base) <= set(every) and (none, nothing) == ([], [])
    added = [s for s in every if s not in base]
    assert [(k, text[a:b]) for k, a, b in added] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert pii.redacted(text, every) == 'see token = "<SECRET>" or <EMAIL>, éé <IP> on 2024-01-02; 2 of 3, v1.2.3'


def test_blocks_of_texts_do_not_touch(field):
    texts = ["token", '= "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, "", "a\n1", "plain words only"]
    texts = [t or "" for t in texts]
    assert pii.all_spans(field, texts) == [pii.all_spans(field, [t])[0] for t in texts]


def test_pii_registered_and_edges(spark, edge, empty, field):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registered.queries()["op10_personal_data"](spark, SF).collect():
        base = brute_base(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) and r.n_secret == sum(x.startswith("secret:") for x in r.spans.split(","))
    clean = pii.redact(edge, field)
    assert clean.columns == edge.columns and [r.text for r in clean.collect()] == [r[1] for r in edge_rows()]
    assert pii.find(empty, field).count() == 0
    assert all(r.spans == "" for r in pii.find(edge, field).collect())


def test_oracles_are_sql_text():
    assert all(isinstance(q, str) for q in registered.oracle_sql().values()) and oracle.WORD
    assert set(registered.oracle_sql()) <= set(registered.queries())
