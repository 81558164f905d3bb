"""Main text of web pages: flat text blocks classified by a decision tree.

The markup is cut into a flat sequence of text blocks at block-level tags. Each block gets its
number of words and its link density, those of the block before and after, and whether its
enclosing elements name it a page part (menu, footer, advert, form, comments) or an article. A
decision tree, grown here on the small labelled pages below, decides which blocks are main text.

A page part holds for what is inside it, up to an article or main element: wrappers of a whole page
are often named after a part they have (has-sidebar, with-menu) or are a form. html and body name
nothing, a form around an article is none, and inside a named wrapper an article or main element
starts anew. A page's later articles stay part of what holds lists of articles (comments, related
pages), and all articles of what is a part by its element or role (nav, aside, footer).

Defined cases: null and empty html gives an empty text. Broken markup (unclosed, cut off) is read
as far as it goes. Rows are read one by one: repeated rows get equal results, a null id stays
null, an empty table gives an empty result. A very long page is read
whole. Columns besides the named ones are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterkit.llm.common import blocks, fields, map_arrow, texts_of

#: Fixed sets of element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section select summary table tbody "
    "td textarea tfoot th thead title tr ul video audio".split()
)
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas select textarea button audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PAGE_PARTS = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer|header|masthead|comment\w*|disqus|reply|replies|respond|"
    r"share|social|related|recommend\w*|pagination|pager|search|login|signup|copyright|legal|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Parts that hold articles of their own, as words of a name; and a whole class of an article that makes it a part.
_LIST_NAME = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|reply|replies|respond|related|recommend\w*)(?:$|[\s_-])", re.I)
_WHOLE_PART_NAME = re.compile(_PART_NAME.pattern.replace(r"[\s_-]", r"\s"), re.I)
_ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])", re.I)
_ARTICLE_ROLE = frozenset(("main", "article"))
_PART_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

_FORM_OR_ARTICLE = re.compile(r"<!--.*?(?:-->|\Z)|<(?:(/form)|article|main)\b|\srole\s*=\s*[\"']?(?:main|article)\b", re.S | re.I)
NAMED, LISTED, FIXED = 1, 2, 4  # a part by its name (or a form), one that lists articles, one by its element or role

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "part", "article", "heading"]


class Block:
    __slots__ = ("text", "n_words", "n_linked", "part", "article", "heading", "label")


def text_blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without hidden elements."""
    out: list[Block] = []
    open_tags: list[tuple[str, int, int, int, int]] = []  # (name, part, article, hidden, label) so far
    parts: list[tuple[str, bool]] = []  # (text, in a link)
    state = (0, 0, 0, 0)
    linked, heading = False, 0
    at, n = 0, len(page)
    articles = 0  # opened outside page parts
    marks: list[tuple[int, bool]] | None = None  # (place, is the end of a form) of forms' ends and articles

    def around_article(at: int) -> bool:
        nonlocal marks
        if marks is None:
            marks = [(m.start(), bool(m[1])) for m in _FORM_OR_ARTICLE.finditer(page) if page[m.start() : m.start() + 4] != "<!--"]
        k = bisect_left(marks, (at, False))
        return k < len(marks) and not marks[k][1]

    def close() -> None:
        nonlocal parts
        text = " ".join(entities.unescape("".join(t for t, _ in parts)).split())
        if text:
            b = Block()
            b.text = text
            b.n_words = text.count(" ") + 1
            b.n_linked = min(b.n_words, sum(len(entities.unescape(t).split()) for t, a in parts if a))
            b.part, b.article, _, b.label = int(state[0] > 0), *state[1:]
            b.heading = heading
            out.append(b)
        parts = []

    while at < n:
        m = _MARK.search(page, at)
        stop = m.start() if m else n
        if stop > at and not state[2]:
            parts.append((page[at:stop], linked))
        if not m:
            break
        at = m.end()
        if m[3] is None and m[6] is None:
            continue  # comment or declaration
        ends, name, attributes = (m[2], m[3].lower(), m[4]) if m[3] is not None else (m[5], m[6].lower(), m[7])
        if name == "a":
            linked = not ends
        elif name == "br":
            parts.append((" ", linked))
        is_block = name in BLOCKS
        if not is_block and name not in HIDDEN:
            if ends or not attributes or name in VOID:
                continue
        if is_block:
            close()
            linked = linked and not is_block
            heading = int(name in HEADINGS and not ends)
        if ends:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    state = open_tags[-1][1:] if open_tags else (0, 0, 0, 0)
                    break
            continue
        if name in VOID:
            continue
        if name == "p" or name == "li":  # a new one ends an open one of its kind beside it
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    del open_tags[i:]
                    state = open_tags[-1][1:] if open_tags else (0, 0, 0, 0)
                    break
                if open_tags[i][0] not in ("p", "span", "b", "i", "em", "strong", "u", "small", "font"):
                    break
        part, article, hidden, label = state
        label |= "data-main" in attributes
        named = [(k.lower(), "".join(v)) for k, *v in _ATTRIBUTE.findall(attributes)] if attributes and name not in ("html", "body") else []
        own = name in ARTICLE or any(k == "role" and v.lower() in _ARTICLE_ROLE for k, v in named)
        if own:
            article = 1
            if not part & FIXED and not (part & LISTED and articles):
                part = 0
        for key, value in named:
            if key == "role":
                part |= FIXED * (value.lower() in _PART_ROLE - {"form"}) | NAMED * (value.lower() == "form" and not around_article(at))
            else:
                part |= NAMED * bool((_WHOLE_PART_NAME if own else _PART_NAME).search(value))
                part |= LISTED * bool(not own and _LIST_NAME.search(value))
                article |= bool(_ARTICLE_NAME.search(value))
        if name in PAGE_PARTS:
            part |= FIXED if name != "form" else NAMED * (not around_article(at))
        articles += own and not part
        hidden |= name in HIDDEN
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else n
        if attributes.endswith("/") and not is_block:
            continue
        open_tags.append((name, int(part), int(article), int(hidden), int(label)))
        state = open_tags[-1][1:]
    close()
    return out


def features(rows: list[list[Block]]) -> np.ndarray:
    """(blocks, FEATURES) of pages' blocks, one page after the other."""
    flat = [b for page in rows for b in page]
    words = np.array([b.n_words for b in flat], float)
    links = np.array([b.n_linked for b in flat], float) / np.maximum(words, 1)
    first = np.zeros(len(flat) + 1, bool)
    first[np.cumsum([0, *(len(p) for p in rows)])] = True

    def beside(x, step):
        if not len(x):
            return x
        other = np.roll(x, step)
        other[first[:-1] if step > 0 else first[1:]] = 0
        return other

    marks = np.array([[b.part, b.article, b.heading] for b in flat], float).reshape(len(flat), 3)
    return np.column_stack([words, links, beside(words, 1), beside(links, 1), beside(words, -1), beside(links, -1), marks])


# ---- decision tree ----


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
    """A binary tree by Gini impurity: (feature, threshold, below, above) or a leaf's share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < cut
            k = int(below.sum())
            if least <= k <= len(y) - least:
                a, b = y[below].mean(), y[~below].mean()
                impurity = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), below)
    if best is None:
        return share
    _, f, cut, below = best
    return f, cut, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """Share of ones in the leaf that each row reaches."""
    out = np.zeros(len(x))

    def walk(node, rows):
        if not isinstance(node, tuple):
            out[rows] = node
            return
        f, cut, below, above = node
        low = x[rows, f] < cut
        walk(below, rows[low])
        walk(above, rows[~low])

    walk(tree, np.arange(len(x)))
    return out


#: The labelled pages: elements marked data-main are main text, all else is not. {n} stands for n words.
PAGES = [
    "<nav><ul><li><a>{1}</a></li><li><a>{1}</a></li><li><a>{2}</a></li></ul></nav><div class=ad>{8}</div><article data-main><h1>{9}</h1><p>{30}</p><p>{2}</p><p>{80}</p><p>{1}</p></article><footer>{9}</footer>",
    "<nav><a>{1}</a> <a>{1}</a></nav><article data-main><h1>{4}</h1><p>{1}</p><p>{3}</p></article><footer>{2} <a>{1}</a></footer>",
    "<header><p>{4}</p></header><main data-main><h2>{5}</h2><p>{60}</p><p>{12} <a>{3}</a> {20}</p></main><aside><p>{40}</p><a>{3}</a></aside><footer><p>{25}</p></footer>",
    "<div class=menu><a>{2}</a><a>{1}</a></div><div id=content data-main><p>{50}</p><p>{45}</p><p>{6}</p></div><div class=sidebar><p>{30}</p></div>",
    "<div class=cookie-notice><p>{35}</p></div><div data-main><p>{70}</p><p>{40}</p><p>{55}</p></div><div><a>{3}</a></div><div>{3}</div>",
    "<form><p>{12}</p><label>{2}</label></form><div data-main><p>{33}</p><p>{26}</p></div><p><a>{4}</a> <a>{4}</a></p><p>{2}</p>",
    "<article data-main><h1>{6}</h1><p>{44}</p><p>{15}</p></article><section class=comments><p>{30}</p><p>{25}</p><p>{3}</p></section><footer>{12}</footer>",
    "<article><div data-main><h1>{6}</h1><p>{44}</p></div><ul><li><a>{5}</a></li><li><a>{6}</a></li><li><a>{7}</a></li></ul></article><div class=comment>{40}</div>",
    "<ul><li><a>{2}</a></li><li><a>{2}</a></li></ul><div>{2}</div><div data-main><p>{90}</p><p>{24}</p><p>{61}</p></div><div>{5}</div><ul><li><a>{3}</a></li></ul>",
    "<div><p>{3}</p><p><a>{2}</a></p></div><p>{4}</p><div data-main><p>{38}</p><p>{52}</p></div><p>{4}</p><p><a>{3}</a></p>",
    "<main data-main><p>{9}</p><ul><li>{4}</li><li>{3}</li></ul><p>{20}</p><table><tr><td>{1}</td><td>{2}</td></tr></table></main><div class=promo>{20}</div>",
    "<div class=post data-main><h1>{3}</h1><blockquote>{14}</blockquote><p>{28}</p></div><div class=share><a>{1}</a><a>{1}</a></div><div class=related><p>{15}</p></div>",
    "<body class='single right-sidebar'><nav><a>{2}</a></nav><article data-main><h1>{5}</h1><p>{40}</p><p>{3}</p></article><div class=right-sidebar><p>{30}</p></div></body>",
    "<div class='page has-sidebar'><main data-main><h1>{4}</h1><p>{50}</p><p>{8}</p></main><div class=sidebar><p>{20}</p></div></div>",
    "<form id=page><div class=menu><a>{1}</a></div><article data-main><p>{25}</p><p>{60}</p></article><div class=comments><article><p>{30}</p></article></div></form>",
    "<main><div class=banner>{11}</div><div data-main><p>{18}</p><p>{35}</p></div><aside>{22}</aside><nav><a>{2}</a></nav></main><footer>{7}</footer>",
]


def train(depth: int = 6):
    """The tree grown on the labelled pages."""
    rows = [text_blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), p)) for p in PAGES]
    return grow(features(rows), np.array([b.label for page in rows for b in page], float), depth)


def main_texts(tree, pages: list[str]) -> list[str]:
    rows = [text_blocks(p) for p in pages]
    kept = iter(classify(tree, features(rows)) >= 0.5)
    return [" ".join(b.text for b in page if next(kept)) for page in rows]


def extract(df: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``df`` without its html, with the main text of each page (a column of that name is replaced)."""
    tree = train()
    rest = df.drop(html_col, name)
    names = rest.columns
    head = f"{fields(rest)}, " if names else ""

    def run(batches):
        for block in blocks(batches, html_col):
            texts = main_texts(tree, texts_of(block, html_col))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, name])

    return map_arrow(df, run, f"{head}`{name}` string")
