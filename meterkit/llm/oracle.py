"""DuckDB statements of the text operators' results, written without their methods."""

from __future__ import annotations

from meterkit.llm.chat import CLOSE, END, OPEN, PARTS, TRAINED
from meterkit.llm.lines import MIN_WORDS as RUN_WORDS
from meterkit.llm.lines import UNIT
from meterkit.llm.spots import ANCHORS, DIGITS
from meterkit.llm.quality import COVERS, DUP_PERCENT, LINE_PERCENT, MIN_WORDS, TOP_PERCENT

WORD = r"[^\x20\x09-\x0D]+"


def repetition() -> str:
    grams, joins, over = [], [], [f"100 * dup_line_chars > {LINE_PERCENT} * word_chars"]
    for n in range(2, 11):
        grams.append(
            f"g{n} AS (SELECT r, i, gram, count(*) OVER (PARTITION BY r, gram) c, row_number() OVER (PARTITION BY r, gram ORDER BY i) k, "
            f"length(replace(gram, ' ', '')) n FROM (SELECT r, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: "
            f"{{'i': i, 'gram': array_to_string(ws[i : i + {n} - 1], ' ')}}), recursive := true) FROM d WHERE len(ws) >= {n}))"
        )
        if n == 3:
            grams.append("c3 AS (SELECT r, count(DISTINCT i + o) x FROM g3, range(0, 3) s(o) WHERE c > 1 GROUP BY r)")
            joins.append(("c3", "n_repeat_words"))
        if n in TOP_PERCENT:
            grams.append(f"t{n} AS (SELECT r, max(c * n) x FROM g{n} WHERE c > 1 GROUP BY r)")
            joins.append((f"t{n}", f"top{n}_chars"))
            over.append(f"100 * top{n}_chars > {TOP_PERCENT[n]} * word_chars")
        if n in DUP_PERCENT:
            grams.append(
                f"p{n} AS (SELECT r, sum(length(ws[j])) x FROM (SELECT DISTINCT r, i + o j FROM g{n}, range(0, {n}) s(o) WHERE k > 1) "
                f"JOIN d USING (r) GROUP BY r)"
            )
            joins.append((f"p{n}", f"dup{n}_chars"))
            over.append(f"100 * dup{n}_chars > {DUP_PERCENT[n]} * word_chars")
    cover = ", ".join(f"coalesce({t}.x, 0)::BIGINT {c}" for t, c in joins)
    join = " ".join(f"LEFT JOIN {t} USING (r)" for t, _ in joins)
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text,
  regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
ln AS (SELECT r, line, i, row_number() OVER (PARTITION BY r, line ORDER BY i) k FROM
  (SELECT r, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM d)
  WHERE regexp_matches(line, '{WORD}')),
dl AS (SELECT r, count(*) n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) c FROM ln WHERE k > 1 GROUP BY r),
{", ".join(grams)},
s AS (SELECT doc_id, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
  coalesce(dl.n, 0) n_dup_lines, coalesce(dl.c, 0)::BIGINT dup_line_chars, {cover}
  FROM d LEFT JOIN dl USING (r) {join}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(over)}) kept, {", ".join(COVERS)} FROM b"""


ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def decontamination(documents: str = "documents") -> str:
    split = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}')"
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {split} ws FROM {documents}),
b AS (SELECT item_id, ws, least(13, len(ws)) w FROM (SELECT item_id, {split} ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i : i + w - 1], ' '))) gram FROM b),
dw AS (SELECT r, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda i:
  {{'i': i, 'gram': array_to_string(ws[i : i + w - 1], ' ')}}), recursive := true) FROM d JOIN (SELECT DISTINCT w FROM win) ON len(ws) >= w),
f AS (SELECT dw.r, dw.i, dw.w, win.item_id FROM dw JOIN win USING (w, gram)),
h AS (SELECT r, count(DISTINCT i + o) n FROM (SELECT DISTINCT r, i, w FROM f) JOIN range(0, 13) s(o) ON o < w GROUP BY r),
t AS (SELECT r, count(*) n, string_agg(item_id, ',' ORDER BY item_id) ids FROM (SELECT DISTINCT r, item_id::VARCHAR item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(h.n, 0) n_hit, coalesce(t.n, 0) n_items, sha256(coalesce(t.ids, '')) items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked_search(k: int = 10) -> str:
    split = f"regexp_extract_all({LOWER}, '{TERM}')"
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {split} ws FROM documents),
tok AS (SELECT r, t, count(*) tf FROM (SELECT r, unnest(ws) t FROM d) GROUP BY r, t),
s AS (SELECT count(*) n_docs, sum(len(ws))::BIGINT n_terms FROM d WHERE len(ws) > 0),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM tok, s GROUP BY t),
i AS (SELECT row_number() OVER () q, item_id, ws FROM (SELECT DISTINCT item_id, text FROM benchmark) x, LATERAL (SELECT {split.replace('text', 'x.text')} ws)),
it AS (SELECT q, t, count(*) times FROM (SELECT q, unnest(ws) t FROM i) GROUP BY q, t),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ws)::BIGINT * n_docs) // n_terms m FROM d, s WHERE len(ws) > 0),
p AS (SELECT q, r, any_value(doc_id) doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT score
  FROM it JOIN w USING (t) JOIN tok USING (t) JOIN m USING (r) GROUP BY q, r)
SELECT item_id, rank::INT rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) rank FROM p WHERE score > 0)
  JOIN i USING (q) WHERE rank <= {k}"""


def collocations(least: int = 100, top: int = 2000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} k, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i : i + {n} - 1], ' '))) phrase FROM p WHERE len(ws) >= {n}" for n in range(1, 6)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, phrase, a, {k} cut, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') x, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') y FROM c WHERE k > {k}" for k in range(1, 5)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, array_to_string(string_split(phrase, ' ')[{i} : {i + m - 1}], ' ') phrase, a FROM c WHERE k > {m} AND k >= {i + m - 1}" for m in range(2, 5) for i in range(1, 7 - m)
    )
    return f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws FROM (SELECT coalesce(lang, 'und') lang,
  unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) piece FROM documents)),
f AS MATERIALIZED (SELECT lang || chr(10) || phrase ident, any_value(lang) lang, any_value(k) k, any_value(phrase) phrase, count(*) f FROM ({grams}) GROUP BY ident),
t AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f a FROM f WHERE k > 1 AND f >= {least}),
e AS MATERIALIZED (SELECT ident, f FROM f WHERE f >= {least}),
u AS MATERIALIZED (SELECT u.*, x.f l FROM ({cuts}) u JOIN e x ON x.ident = lang || chr(10) || x),
v AS MATERIALIZED (SELECT u.*, y.f r FROM u JOIN e y ON y.ident = lang || chr(10) || y),
s AS (SELECT v.*, t.n, ((1000::HUGEINT * a * t.n) // (l::HUGEINT * r))::BIGINT score FROM v JOIN t USING (lang)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) longer FROM ({inner}) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM kept) WHERE rank <= {top}"""


def fingerprints() -> str:
    anchors = ", ".join(f"'{w.decode()}'" for w in sorted(ANCHORS))
    split = f"regexp_extract_all({LOWER}, '{TERM}')"
    near = "CASE WHEN {0} = 0 AND {1} = 0 THEN 1 ELSE {2}::DOUBLE / ({0} + {1} - {2}) END"
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text, length(coalesce(text, '')) n FROM documents),
o AS (SELECT *, coalesce(lead(r) OVER w, first_value(r) OVER w) nr, coalesce(lead(text) OVER w, first_value(text) OVER w) nt FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, r)),
e AS (SELECT r, doc_id, n, nr, text, substring(text, 1, n - n // 3) || substring(nt, 1, n // 3) edited FROM o),
x AS (SELECT r, side, {split} ws FROM (SELECT r, 'own' side, text FROM e UNION ALL SELECT r, 'edited', edited FROM e)),
w AS (SELECT r, side, i, w, w IN ({anchors}) anchor, sum((w NOT IN ({anchors}))::INT) OVER (PARTITION BY r, side ORDER BY i) c
  FROM (SELECT r, side, unnest(ws) w, generate_subscripts(ws, 1) i FROM x)),
c AS (SELECT r, side, c, w FROM w WHERE NOT anchor),
g AS (SELECT w.r, w.side, w.w || ':' || a.w || coalesce(':' || b.w, '') sig FROM w JOIN c a ON a.r = w.r AND a.side = w.side AND a.c = w.c + 1
  LEFT JOIN c b ON b.r = w.r AND b.side = w.side AND b.c = w.c + 2 WHERE w.anchor OR md5(w.w)[1] = '0'
  UNION ALL SELECT r, side, '^:' || array_to_string(ws[1:2], ':') FROM x WHERE len(ws) > 0),
h AS MATERIALIZED (SELECT DISTINCT r, side, substring(md5(sig), 1, {DIGITS}) h FROM g),
f AS (SELECT r, side, count(*) n, string_agg(h, '' ORDER BY h) f FROM h GROUP BY r, side),
ee AS (SELECT a.r, count(*) eq FROM h a JOIN h b ON a.r = b.r AND a.h = b.h WHERE a.side = 'own' AND b.side = 'edited' GROUP BY a.r),
en AS (SELECT a.r, count(*) eq FROM h a JOIN e USING (r) JOIN h b ON b.r = e.nr AND a.h = b.h WHERE a.side = 'own' AND b.side = 'own' GROUP BY a.r),
s AS (SELECT e.*, coalesce(o.n, 0) own_n, coalesce(x.n, 0) edited_n, coalesce(t.n, 0) next_n, coalesce(o.f, '') own_f, coalesce(x.f, '') edited_f, coalesce(ee.eq, 0) be, coalesce(en.eq, 0) bn
  FROM e LEFT JOIN f o ON o.r = e.r AND o.side = 'own' LEFT JOIN f x ON x.r = e.r AND x.side = 'edited' LEFT JOIN f t ON t.r = e.nr AND t.side = 'own'
  LEFT JOIN ee ON ee.r = e.r LEFT JOIN en ON en.r = e.r)
SELECT doc_id, n n_chars, sha256(edited) edited_sha256, own_f fingerprint, edited_f edited_fingerprint, {near.format("own_n", "edited_n", "be")} near_edited,
  {near.format("own_n", "next_n", "bn")} near_next, own_n n_signatures FROM s"""


def repeated_passages() -> str:
    unit = UNIT.replace("\n", "\\n")
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{unit}') us FROM documents),
u AS (SELECT r, doc_id, i, unit, sum(length(unit)) OVER (PARTITION BY r ORDER BY i) e,
  regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws
  FROM (SELECT r, doc_id, unnest(us) unit, generate_subscripts(us, 1) i FROM d)),
w AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) place FROM u WHERE len(ws) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id NULLS LAST, r, place) k FROM w),
q AS (SELECT *, place - row_number() OVER (PARTITION BY r ORDER BY place) run FROM o WHERE k > 1),
s AS (SELECT r, min(e - length(unit)) a, max(e) b, count(*) n FROM q GROUP BY r, run HAVING sum(len(ws)) >= {RUN_WORDS}),
t AS (SELECT r, sum(n)::BIGINT n, string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) spans FROM s GROUP BY r),
x AS (SELECT u.r, string_agg(unit, '' ORDER BY i) kept FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.r = u.r AND u.e > s.a AND u.e <= s.b) GROUP BY u.r)
SELECT doc_id, coalesce(t.n, 0) n_removed, coalesce(t.spans, '') removed, length(coalesce(x.kept, '')) n_kept_chars, sha256(coalesce(x.kept, '')) kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN x USING (r)"""


def preference_format() -> str:
    mark = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    role, text = "coalesce(role, 'unknown')", "coalesce(text, '')"
    render = f"{mark(OPEN)} || {role} || {mark(CLOSE)} || {text} || {mark(END)}"
    head, body = f"(length({role}) + {len(OPEN + CLOSE)})", f"(length({text}) + {len(END)})"
    mask = f"CASE WHEN role IS NOT DISTINCT FROM '{TRAINED}' THEN {head} || ':0,' || {body} || ':1' ELSE ({head} + {body}) || ':0' END"
    side = lambda n: f"""{n} AS (SELECT p.id, string_agg({render}, '' ORDER BY pos) x, string_agg({mask}, ',' ORDER BY pos) m
  FROM k p JOIN t ON t.conv_id = p.{n}_id WHERE pos > p.n GROUP BY p.id)"""  # noqa: E731
    return f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) pos
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY role, text ORDER BY ((conv_id % {PARTS}) + {PARTS}) % {PARTS}, conv_id) - 1 i FROM t WHERE pos = 1),
p AS (SELECT row_number() OVER () id, max(conv_id) FILTER (i % 2 = 0) chosen_id, max(conv_id) FILTER (i % 2 = 1) rejected_id FROM f GROUP BY role, text, i // 2),
b AS (SELECT id, a.pos, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AND b.pos IS NOT NULL same
  FROM p JOIN t a ON a.conv_id = chosen_id LEFT JOIN t b ON b.conv_id = rejected_id AND b.pos = a.pos WHERE rejected_id IS NOT NULL),
c AS (SELECT id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) n FROM b GROUP BY id),
k AS (SELECT p.*, coalesce(c.n, 0) n FROM p LEFT JOIN c USING (id)),
{side("chosen")}, {side("rejected")},
q AS (SELECT k.id, string_agg({render}, '' ORDER BY pos) x FROM k JOIN t ON t.conv_id = k.chosen_id WHERE pos <= k.n GROUP BY k.id)
SELECT chosen_id, rejected_id, k.n n_prompt_turns, coalesce(q.x, '') prompt, coalesce(chosen.x, '') chosen, coalesce(chosen.m, '') chosen_mask,
  CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected.x, '') END rejected, CASE WHEN rejected_id IS NOT NULL THEN coalesce(rejected.m, '') END rejected_mask
FROM k LEFT JOIN q USING (id) LEFT JOIN chosen USING (id) LEFT JOIN rejected USING (id)"""


def ngram_jaccard() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({low}, '{WORD}') ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END g FROM d),
g AS MATERIALIZED (SELECT r, len(g) n, unnest(g) gram FROM s),
l AS MATERIALIZED (SELECT a.r a, b.r b FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t(r, x) AS (SELECT r, r FROM s UNION SELECT t.r, l.b FROM t JOIN l ON l.a = t.x)
SELECT any_value(s.doc_id) doc_id, any_value(len(s.g)) n_shingles, min(o.doc_id) component_id
FROM t JOIN s ON s.r = t.r JOIN s o ON o.r = t.x GROUP BY t.r"""
