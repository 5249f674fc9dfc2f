"""HTML main-text extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page becomes its leaf blocks: runs of text between block-level tags, in page order, with the open ancestor elements and
the words of their class, id and role attributes. Features are ancestor tags, attribute words, and traits of the text
(length, links, punctuation, place in the page). The field is trained on labelled pages: :func:`training_pages` writes
pages in many layouts (article containers of several kinds, menus, headers, sidebars, notices, adverts, forms, reader
comments, footers) whose blocks are labelled as they are written. Blocks labelled as main text are joined.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .crf import ChainCRF, Chains

TABLE = 1 << 14

# HTML elements by their role in the text flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video head textarea select title".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Elements that a new element of the key closes when they are open.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote details div dl fieldset figure footer form header hr main menu nav ol pre section table ul".split())
BARRIER = frozenset("ul ol dl table body html article section main div nav aside footer header form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
#: Name and value of every attribute in turn, so that a value is never read as a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMING = frozenset("class id role itemprop".split())
ATTRIBUTE_WORD = re.compile(r"[a-z]+")


class Block:
    """A run of text. ``context``: numbers of the features of its open elements; ``base``: their emission scores' sum."""

    __slots__ = ("base", "context", "linked", "parts", "path", "text")

    def __init__(self, path: list[str], context: frozenset[int], base: np.ndarray | None) -> None:
        self.path, self.context, self.base, self.parts, self.linked, self.text = path, context, base, [], 0, ""


class Open:
    """The open elements. Every question about them, and every change, costs no more than what it pushes or pops, so a page
    with many unclosed elements takes time in proportion to its length."""

    def __init__(self, emit: np.ndarray | None) -> None:
        self.emit = emit
        self.names: list[str] = []
        self.numbers: list[tuple[int, ...]] = []
        self.shut: list[bool] = []  # its text doesn't show
        self.barriers = [0]  # barriers among the first k elements
        self.where: dict[str, list[int]] = {}
        self.path: list[str] = []  # those that aren't inline
        self.count: dict[int, int] = {}  # open elements that give a feature
        self.base = np.zeros(emit.shape[1]) if emit is not None else None
        self.hidden = 0

    def push(self, name: str, words: tuple[str, ...] | None) -> None:
        group = "heading" if name in HEADINGS else name
        self.where.setdefault(group, []).append(len(self.names))
        numbers = tuple(_number(f"word:{w}") for w in words or ())
        if name not in INLINE:
            self.path.append(name)
            numbers += (_number(f"anc:{name}"),)
        for x in numbers:
            self.count[x] = now = self.count.get(x, 0) + 1
            if now == 1 and self.base is not None:
                self.base = self.base + self.emit[x]
        self.names.append(name)
        self.numbers.append(numbers)
        self.shut.append(name in HIDDEN or words is None)
        self.hidden += self.shut[-1]
        self.barriers.append(self.barriers[-1] + (name in BARRIER))

    def last(self, group: str) -> int | None:
        found = self.where.get(group)
        return found[-1] if found else None

    def barrier_above(self, k: int) -> bool:
        return self.barriers[-1] > self.barriers[k + 1]

    def leave(self, k: int) -> None:
        while len(self.names) > k:
            name = self.names.pop()
            self.where["heading" if name in HEADINGS else name].pop()
            if name not in INLINE:
                self.path.pop()
            for x in self.numbers.pop():
                self.count[x] -= 1
                if not self.count[x]:
                    del self.count[x]
                    if self.base is not None:
                        self.base = self.base - self.emit[x]
            self.hidden -= self.shut.pop()
            self.barriers.pop()


@lru_cache(maxsize=4096)
def _attributes(raw: str) -> tuple[str, ...] | None:
    """Words of the naming attributes; None if the element is hidden."""
    found: list[str] = []
    for m in ATTRIBUTE.finditer(raw):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            return None
        if name in NAMING:
            spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower()
            found += ATTRIBUTE_WORD.findall(spaced)
    return tuple(dict.fromkeys(found))


def blocks(page: str, emit: np.ndarray | None = None) -> list[Block]:
    """Leaf blocks with text, in page order. Unclosed and stray tags are tolerated.

    With ``emit``, the field's scores, blocks get the sum of their context's scores in place of its numbers.
    """
    out: list[Block] = []
    stack = Open(emit)
    here: Block | None = None

    def text(raw: str) -> None:
        nonlocal here
        if stack.hidden or not raw:
            return
        if here is None:
            if raw.isspace():
                return
            here = Block(stack.path[-2:], frozenset(stack.count) if emit is None else frozenset(), stack.base)
        raw = html.unescape(raw) if "&" in raw else raw
        here.parts.append(raw)
        if stack.where.get("a"):
            here.linked += len(raw)

    def flush() -> None:
        nonlocal here
        if here is not None:
            here.text = " ".join("".join(here.parts).split())
            if here.text:
                out.append(here)
            here = None

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            if name == "br":
                text(" ")
                continue
            flush()
        if m[1]:
            k = stack.last("heading" if name in HEADINGS else name)
            if k is not None and not (name in INLINE and stack.barrier_above(k)):
                stack.leave(k)
            continue
        if name in VOID or m[3].endswith("/") and name not in RAW:
            continue
        if name in RAW:  # its text ends at its own end tag only
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        for other in CLOSES.get(name, ("p",) if name in ENDS_P else ()):
            k = stack.last(other)
            if k is not None and not stack.barrier_above(k):
                stack.leave(k)
        if name == "body" and (k := stack.last("head")) is not None:
            stack.leave(k)
        stack.push(name, _attributes(m[3]) if m[3] else ())
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _number(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return 1 + (h ^ h >> 15) % (TABLE - 1)


def own_features(page: list[Block]) -> list[list[int]]:
    """Numbers of the traits of each block's text and place, apart from its context, and of the bias."""
    out = []
    n = len(page)
    for k, b in enumerate(page):
        text, size = b.text, len(b.text)
        last = b.path[-1] if b.path else "none"
        length = min(8, size.bit_length())
        share = b.linked * 4 // max(1, size)
        names = [f"last:{last}", f"path:{'/'.join(b.path)}", f"long:{length}", f"link:{min(3, share)}", f"last-long:{last}:{length}"]
        names.append("place:first" if k == 0 else "place:last" if k == n - 1 else "place:inner")
        names.append("ends" if text[-1] in ".!?…:;\"»”'" else "no-end")
        if text[0] in "©®" or "©" in text[:40]:
            names.append("copyright")
        if "," in text:
            names.append("comma")
        if text.count(". ") > 1:
            names.append("sentences")
        out.append([0, *sorted({_number(x) for x in names})])
    return out


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of all features, for pages that were read without scores."""
    return [[*own, *sorted(b.context)] for own, b in zip(own_features(page), page, strict=True)]


def page_scores(model: ChainCRF, pages: list[list[Block]]) -> np.ndarray:
    """Emission scores of the blocks of pages that were read with the model's."""
    rows = [f for page in pages for f in own_features(page)]
    flat = np.array([x for row in rows for x in row], np.int64)
    return model.scores(flat, np.cumsum([0, *(len(x) for x in rows)])) + np.array([b.base for page in pages for b in page])


LINES = "news about contact home topics world sport terms privacy archive search login help shop team".split()


def training_pages(seed: int = 7, count: int = 1000) -> list[tuple[str, list[tuple[str, int]]]]:
    """Labelled pages: (html, [(block text, 1 for main text)]). Text is random, so only structure can be learnt."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v z ch sh th".split() for b in "a e i o u an en on er".split()]
    word = lambda: "".join(r.choices(syllables, k=r.choice((1, 1, 2, 2, 3))))
    phrase = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda: phrase(4, 14).capitalize() + r.choice("..!?")
    prose = lambda lo, hi: " ".join(sentence() for _ in range(r.randint(lo, hi)))

    def menu(tag: str, name: str) -> list:
        links = [(f'<li><a href="/{word()}">', phrase(1, 2) if r.random() < 0.7 else r.choice(LINES), "</a></li>", 0) for _ in range(r.randint(2, 7))]
        return [(f"<{tag}{name}><ul>", None, "", 0), *links, ("</ul>" + f"</{tag}>", None, "", 0)]

    def attr(*names: str) -> str:
        return r.choice(("", *(f' class="{x}"' for x in names), *(f' id="{x}"' for x in names)))

    def must(*names: str) -> str:
        return r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="box {r.choice(names)}-{r.choice(("wrap", "inner", "item", "block"))}"'))

    def body_block(main: int) -> list:
        kind = r.random()
        if kind < 0.72:
            return [("<p>", prose(1, 6) if r.random() < 0.8 else phrase(1, 5), "</p>", main)]
        if kind < 0.8:
            return [(f"<h{r.randint(2, 4)}>", phrase(2, 7), "</h3>", main)]
        if kind < 0.87:
            return [("<ul>", None, "", 0), *[("<li>", phrase(3, 12) + r.choice(("", ".")), "</li>", main) for _ in range(r.randint(2, 4))], ("</ul>", None, "", 0)]
        if kind < 0.92:
            return [("<blockquote><p>", prose(1, 3), "</p></blockquote>", main)]
        if kind < 0.95:
            return [("<pre>", phrase(4, 10), "</pre>", main)]
        if kind < 0.97:
            return [("<table><tr><td>", phrase(1, 3), "</td>", main), ("<td>", phrase(1, 3), "</td></tr></table>", main)]
        return [("<figure><img src='x.png'><figcaption>", phrase(4, 9), "</figcaption></figure>", main)]

    def article() -> list:
        tag, name = r.choice((("article", ""), ("article", ""), ("article", attr("post", "story", "entry")), ("main", ""), ("main", attr("content")), ("div", must("content", "main", "post", "entry", "story", "article", "article-body", "post-content", "text", "main-content")), ("section", must("content", "article", "post"))))
        out = [(f"<{tag}{name}>", None, "", 0)]
        if r.random() < 0.1:
            out = [("<main>", None, "", 0), *out]
        if r.random() < 0.85:
            head = r.random() < 0.2
            out.append((("<header>" if head else "") + "<h1>", phrase(3, 10) + r.choice(("", "", ".")), "</h1>" + ("</header>" if head else ""), 1))
        for _ in range(r.randint(1, 9)):
            out += body_block(1)
            if r.random() < 0.06:
                out += advert()
        return [*out, (f"</{tag}>", None, "", 0)]

    def advert() -> list:
        tag = r.choice(("div", "div", "aside", "section"))
        return [(f"<{tag}{must('ad', 'ads', 'advert', 'advertisement', 'sponsor', 'sponsored', 'promo', 'banner')}>" + r.choice(("", "<p>")), prose(1, 2) if r.random() < 0.7 else phrase(2, 6), f"</{tag}>", 0)]

    def notice() -> list:
        tag = r.choice(("div", "section", "aside"))
        return [(f"<{tag}{must('cookie', 'consent', 'notice', 'gdpr', 'alert', 'newsletter', 'subscribe', 'paywall', 'popup', 'modal', 'warning')}><p>", prose(1, 3), "</p>", 0), *([("<button>", phrase(1, 2), "</button>", 0)] if r.random() < 0.6 else []), (f"</{tag}>", None, "", 0)]

    def sidebar() -> list:
        tag, name = r.choice((("aside", attr("sidebar")), ("div", must("sidebar", "related", "widget", "recommended", "trending", "popular", "share", "social", "tags", "author", "breadcrumb")), ("section", must("related", "more"))))
        inner = [x for _ in range(r.randint(1, 3)) for x in ([("<h3>", phrase(1, 4), "</h3>", 0)] + [("<p>" if r.random() < 0.6 else "<li><a href='#'>", prose(1, 2) if r.random() < 0.5 else phrase(2, 8), "</a></p>", 0)])]
        return [(f"<{tag}{name}>", None, "", 0), *inner, (f"</{tag}>", None, "", 0)]

    def comments() -> list:
        tag = r.choice(("div", "section", "ol"))
        
        def one() -> list:
            inner = r.choice(("div", "li", "div", "article"))
            return [(f"<{inner} class='{r.choice(('comment', 'reply', 'comment-body'))}'>" + r.choice(("<p>", "")), prose(1, 3), f"</{inner}>", 0)]

        head = [("<h3>", r.choice(("Comments", "Replies", phrase(1, 3))), "</h3>", 0)] if r.random() < 0.7 else []
        return [(f"<{tag}{must('comments', 'comment-list', 'responses', 'discussion', 'disqus', 'replies')}>", None, "", 0), *head, *[x for _ in range(r.randint(1, 4)) for x in one()], (f"</{tag}>", None, "", 0)]

    def form() -> list:
        return [(f"<form{attr('search', 'login', 'newsletter', 'comment-form')}><label>", phrase(1, 4), "</label><input type=text>", 0), ("<p>" if r.random() < 0.4 else "<button>", phrase(1, 8), "</p></button>", 0), ("</form>", None, "", 0)]

    def header() -> list:
        tag, name = r.choice((("header", ""), ("header", attr("site-header", "masthead", "top")), ("div", must("header", "masthead", "topbar", "site-header", "branding"))))
        inner = r.choice(("h1", "p", "a", "span"))
        return [(f"<{tag}{name}><{inner}>", phrase(1, 5), f"</{inner}>", 0), (f"</{tag}>", None, "", 0)]

    def footer() -> list:
        tag, name = r.choice((("footer", ""), ("footer", attr("site-footer")), ("div", must("footer", "copyright", "legal", "bottom", "site-footer"))))
        text = r.choice(("&copy; ", "© 2024 ", "")) + word() + r.choice((".example.com", "")) + r.choice((" &middot; ", " ")) + prose(1, 3)
        return [(f"<{tag}{name}>" + r.choice(("", "", "<p>")), text, "</p>", 0), (f"</{tag}>", None, "", 0)]

    pages = []
    for _ in range(count):
        parts = []
        much = 0.15 if r.random() < 0.2 else 1.0  # some pages are hardly more than their article
        chance = lambda p, much=much: r.random() < p * much
        parts += header() if chance(0.45) else []
        parts += menu(*r.choice((("nav", ""), ("nav", attr("menu")), ("div", must("nav", "menu", "navbar", "navigation"))))) if chance(0.85) else []
        for make, p in ((notice, 0.3), (advert, 0.45), (form, 0.2), (sidebar, 0.25)):
            parts += make() if chance(p) else []
        parts += article()
        tail = [(comments, 0.4), (sidebar, 0.35), (advert, 0.25), (form, 0.25), (notice, 0.2)]
        r.shuffle(tail)
        for make, p in tail:
            parts += make() if chance(p) else []
        parts += menu("nav", "") if chance(0.1) else []
        parts += footer() if chance(0.85) else []
        page = "<!DOCTYPE html><html><head><title>" + phrase(2, 5) + "</title><script>var x='<p>no</p>';</script></head><body>"
        label = []
        for before, text, after, main in parts:
            page += before
            if text is not None:
                page += (f"<b>{text[:9]}</b>{text[9:]}" if chance(0.1) and "&" not in text else text) + after
                label.append((" ".join(html.unescape(text).split()), main))
            else:
                page += after
        pages.append((page + r.choice(("</body></html>", "")), label))
    return pages


def train(pages: list[tuple[str, list[tuple[str, int]]]] | None = None) -> ChainCRF:
    rows, offsets, label = [], [0], []
    for page, marked in pages if pages is not None else training_pages():
        found = blocks(page)
        want = dict(marked)
        rows += features(found)
        label += [want.get(b.text, 0) for b in found]
        offsets.append(len(rows))
    flat = np.array([x for row in rows for x in row], np.int64)
    begin = np.cumsum([0, *(len(x) for x in rows)])
    return ChainCRF(2, TABLE).fit(flat, begin, np.array(offsets), np.array(label), rounds=60, rate=0.5)


def main_texts(model: ChainCRF, pages: list[str | None]) -> list[str]:
    """The main text of every page: its blocks that Viterbi decoding labels so, joined by one blank."""
    found = [blocks(p, model.emit) if p else [] for p in pages]
    if not any(found):
        return ["" for _ in pages]
    offsets = np.cumsum([0, *(len(p) for p in found)])
    label = model.viterbi(page_scores(model, found), Chains(offsets))
    return [" ".join(b.text for b, y in zip(page, label[offsets[k] : offsets[k + 1]].tolist(), strict=True) if y) for k, page in enumerate(found)]


def extract(spark: SparkSession, pages: DataFrame, model: ChainCRF | None = None, step: int = 256) -> DataFrame:
    """Main text of every row: page_id, url, text (empty if none) and n_chars (its code points).

    Null and empty html give empty text. Character references are decoded, white space in a block becomes one blank, and
    nothing is dropped or capped but whole blocks. Extra columns are ignored; repeated rows give equal rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    shared = spark.sparkContext.broadcast(model or train())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for i in range(0, batch.num_rows, step):
                texts += main_texts(shared.value, batch.column(2).slice(i, step).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("page_id", "url", "cast(html AS string) AS html").mapInArrow(emit, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
