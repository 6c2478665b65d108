"""Main text of web pages: flat blocks, their neighbours' words and links, and a decision tree."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftcast.llm.common import map_batches

#: Elements whose content is no text of the page, elements that begin and end a block, and elements
#: that stand for the frame of a page.
SILENT = set("script style noscript template svg iframe object canvas textarea select title audio video".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
FRAME = set("nav header footer aside form menu dialog button label fieldset".split())
#: Block elements that hold other blocks: what is said of them holds for all in them.
CONTAINERS = BLOCKS - set("hr p li dt dd h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot caption".split()) | {"button", "label"}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
#: Names of other languages that say the same as a name of the labelled table.
SAME = {
    "werbung": "ad", "anzeige": "ad", "publicidad": "ad", "anuncio": "ad", "publicite": "ad", "kommentar": "comment", "kommentare": "comments",
    "comentario": "comment", "comentarios": "comments", "commentaire": "comment", "commentaires": "comments", "fusszeile": "footer", "kopfzeile": "header",
    "seitenleiste": "sidebar", "navegacion": "navigation", "verwandt": "related", "relacionados": "related", "suche": "search", "hinweis": "notice", "aviso": "notice"}
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "heading", "item", "in_article", "frame", "name_inside", "name_outside")


class Names(dict):
    """How much more often a word of class, id or role stands over main text than over the rest: log odds, learnt."""

    def of(self, words: frozenset[str]) -> float:
        """The sum over an element's words; words that were not learnt count nothing."""
        return sum(self.get(w, 0.0) for w in words)


@dataclass(eq=False)
class Element:
    """A named container: its names, its words that are not linked, whether it holds a heading of the first level, and whether it is the page's main part."""

    names: frozenset[str]
    words: int = 0
    headed: bool = False
    main: bool = False


@dataclass
class Block:
    """A flat text block: its text, counts of its words, what it stands in, and the label of a training page."""

    text: str
    words: int
    linked: int
    heading: int
    item: int
    in_article: int
    frame: int
    inside: tuple[Element, ...]
    outside: tuple[Element, ...]
    label: int = 0


@dataclass(frozen=True)
class _Place:
    """An open container: whether in an article and in the page's frame, and names of it and of those around it."""

    tag: str = ""
    in_article: int = 0
    frame: int = 0
    inside: tuple[Element, ...] = ()
    outside: tuple[Element, ...] = ()


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(rest)} if rest and not rest.isspace() else {}


def _names(attrs: dict[str, str]) -> frozenset[str]:
    return frozenset(SAME.get(w, w) for k in ("class", "id", "role") if k in attrs for w in _WORD.findall(attrs[k].lower()))


def _entered(at: _Place, tag: str, attrs: dict[str, str]) -> _Place:
    """The place inside an element. An article's names come anew: those around it are outside."""
    names = (Element(found),) if (found := _names(attrs)) else ()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    frame = int(at.frame or hidden or tag in FRAME and not (tag == "header" and at.in_article))
    if tag in ("article", "main") and not at.in_article:
        return _Place(tag, 1, frame, names, at.outside + at.inside)
    return _Place(tag, at.in_article, frame, at.inside + names, at.outside)


def markup(page: str):
    """The parts of a page in order: (text, None, False, "") or ("", tag, whether it closes, attributes as written).

    Comments, declarations and what stands in silent elements are left out. Each part is looked at once, so time
    grows with the page's length: what is not closed ends with the page, and after one tag whose quotes do not end
    the first ">" ends every tag.
    """
    at, n, last, quotes, cdata = 0, len(page), page.rfind(">"), True, True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], None, False, ""
            return
        mark = page[lt + 1:lt + 2]
        if mark not in "!?/" and not mark.isalpha() or not mark:
            yield page[at:lt + 1], None, False, ""
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], None, False, ""
        if lt > last:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
        elif cdata and page.startswith("<![CDATA[", lt) and (end := page.find("]]>", lt)) >= 0:
            at = end + 3
        elif not (name := _NAME.match(page, lt + 1)):
            cdata = cdata and not page.startswith("<![CDATA[", lt)
            at = page.find(">", lt) + 1
        else:
            m = _OPEN.match(page, lt) if quotes else None
            quotes = m is not None
            end = m.end() if m else page.find(">", lt) + 1
            tag, close = name[1].lower(), mark == "/"
            rest = m[3] if m else page[name.end():end - 1]
            at = end
            if tag not in SILENT:
                yield "", tag, close, rest
            elif not close and not rest.endswith("/"):
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, end)
                at = page.find(">", stop.start()) + 1 or n if stop else n


def blocks(page: str, label: str | None = None) -> list[Block]:
    """The flat text blocks of a page in order, empty ones left out; label names the attribute of marked blocks.

    A block ends where a block element starts or ends. Its text is that of the page without
    markup, with character references decoded and runs of white space as one space. Elements
    left open end with what encloses them. An element that holds a first-level heading and half or more of the words that are
    not linked is the page's main part, whatever its names say.
    """
    out: list[Block] = []
    stack: list[_Place] = [_Place()]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    link = False
    own, heading, item, mark, top, total = stack[0], 0, 0, 0, False, 0

    def flush():
        nonlocal total
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            words, of_links = text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()) if linked else 0
            out.append(Block(text, words, of_links, heading, item, own.in_article, own.frame, own.inside, own.outside, mark))
            total += max(0, words - of_links)
            for e in own.inside + own.outside:
                e.words += max(0, words - of_links)
                e.headed = e.headed or top
        parts.clear()
        linked.clear()

    for text, tag, close, rest in markup(page):
        if tag is None:
            parts.append(text)
            if link:
                linked.append(text)
        elif tag == "a":
            link = not close
        elif tag == "br":
            parts.append(" ")
        elif tag in CONTAINERS:
            flush()
            link, heading, item, mark, top = False, 0, 0, 0, False
            if not close:
                if not rest.endswith("/"):
                    stack.append(_entered(stack[-1], tag, _attributes(rest)))
                    depth[tag] += 1
            elif depth[tag]:
                while (gone := stack.pop().tag) != tag:
                    depth[gone] -= 1
                depth[tag] -= 1
            own = stack[-1]
        elif tag in BLOCKS:
            flush()
            link, own, mark = False, stack[-1], 0
            heading, item, top = int(not close and tag[0] == "h" and tag[1:].isdigit()), int(not close and tag == "li"), not close and tag == "h1"
            if not close and (attrs := _attributes(rest)):
                own = _entered(own, tag, attrs)
                mark = int(label is not None and label in attrs)
    flush()
    for b in out:
        for e in b.inside + b.outside:
            e.main = e.headed and 2 * e.words >= total
    return out


def features(found: list[Block], names: Names) -> np.ndarray:
    """One row of FEATURES for each block."""
    own = np.array([[b.words, min(1.0, b.linked / b.words)] for b in found]).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    memo: dict[tuple, float] = {(): 0.0}

    def least(around: tuple[Element, ...]) -> float:
        """The lowest of the elements' log odds, as one sidebar makes a sidebar of all in it; the highest if none is below 0.

        Names that speak against the page's main part count nothing: what an article is called does not outvote its text.
        """
        if around not in memo:
            each = [max(0.0, names.of(e.names)) if e.main else names.of(e.names) for e in around]
            memo[around] = min(each) if min(each) < 0 else max(each)
        return memo[around]

    rest = np.array([[b.heading, b.item, b.in_article, b.frame, least(b.inside), least(b.outside)] for b in found]).reshape(-1, 6)
    return np.concatenate([own, before, after, rest], axis=1)[: len(found)]


@dataclass(frozen=True)
class Tree:
    """A binary decision tree: a leaf has a share of main text, a node a feature and a threshold."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        left = x[:, self.feature] <= self.threshold
        out = np.empty(len(x))
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 12) -> Tree:
    """A tree that splits by Gini impurity; ties go to the earlier feature and lower threshold."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return Tree(share)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, q = c[:-1] / n, (c[-1] - c[:-1]) / (len(y) - n)
        cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
        ok = (v[:-1] < v[1:]) & (n >= least) & (len(y) - n >= least)
        if ok.any():
            k = int(np.argmin(np.where(ok, cost, np.inf)))
            if best is None or cost[k] < best[0] - 1e-12:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return Tree(share)
    left = x[:, best[1]] <= best[2]
    return Tree(share, best[1], float(best[2]), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


#: The labelled table, one row for each kind of part: whether it is main text, elements that it comes as, names that it
#: comes with (class, id or role, one or two at a time; "" is none), and its fillings.
PARTS = [
    (0, "nav div ul", "menu nav navbar navigation menubar toolbar tabs links", "links"),
    (0, "nav div ol", "breadcrumb breadcrumbs crumbs trail", "links"),
    (0, "header div", "header masthead banner top topbar branding logo site", "line links"),
    (0, "footer div", "footer foot bottom copyright contentinfo colophon legal imprint", "line prose links"),
    (0, "aside div section", "sidebar side rail widget complementary aside box", "teaser prose links"),
    (0, "section div aside", "related recommended trending more popular latest also read next", "teaser links entries"),
    (0, "div section aside", "ad ads advert advertisement adbox sponsored sponsor promo promoted promotion banner", "prose line"),
    (0, "div section", "cookie cookies consent notice notices alert gdpr warning popup modal overlay notification message disclaimer paywall", "prose line"),
    (0, "form div", "form search login register signup newsletter subscribe subscription donate captcha feedback", "line prose"),
    (0, "div ul", "share sharing social tags tag pager pagination follow", "links"),
    (0, "section div article", "comment comments reply replies respond discussion disqus responses", "prose entries line"),
    (1, "article main div section", "article post entry story content body text main page hentry", "article"),
    (1, "article main div section", "", "article"),
]
#: Names of containers within an article, which say little of themselves.
WITHIN = "text body content story lead intro summary figure caption quote note message list table section chapter column feature free post tags".split()
_TALK = "rain hill dam river bridge road house bee garden music winter market boat school doctor paper stone light field horse train letter window bread".split()


def labelled_pages(n: int = 2000, seed: int = 5) -> list[str]:
    """Pages drawn from the labelled table by a seed: parts of a frame around an article, whose blocks carry data-main.

    A fifth of the pages have no names and no telling elements, only div and p, so that there words and links must tell.
    """
    rnd = random.Random(seed)
    frame, main = [p for p in PARTS if not p[0]], [p for p in PARTS if p[0]]

    def talk(lo: int, hi: int) -> str:
        return " ".join(rnd.choices(_TALK, k=rnd.randint(lo, hi))).capitalize() + rnd.choice(". . ? !".split())

    def linked(text: str) -> str:
        return f"<a href=/x>{text}</a>"

    def filling(kind: str) -> str:
        if kind == "links":
            return rnd.choice(["", "<ul>"]) + rnd.choice([" ", " | ", "<li>"]).join(linked(talk(1, 4)) for _ in range(rnd.randint(2, 7)))
        if kind == "line":
            return f"<p>{talk(2, 12)}" + (f" {linked(talk(1, 3))}" if rnd.random() < 0.3 else "")
        if kind == "teaser":
            return f"<h3>{talk(2, 4)}</h3>" + "".join(f"<p>{linked(talk(3, 9))} {talk(0, 9)}</p>" for _ in range(rnd.randint(1, 3)))
        if kind == "entries":
            return "".join(f"<article><h4>{linked(talk(1, 3))}</h4><p>{talk(5, 40)}</p></article>" for _ in range(rnd.randint(1, 4)))
        return "".join(f"<p>{talk(8, 30)}</p>" for _ in range(rnd.randint(1, 2)))

    def article(marked: bool) -> str:
        out = [f"<h1 data-main>{talk(2, 8)}</h1>"] if rnd.random() < 0.9 else []
        for _ in range(rnd.randint(2, 8)):
            draw = rnd.random()
            some = "".join(f"<p data-main>{talk(1 if rnd.random() < 0.2 else 10, 60)}</p>" for _ in range(rnd.randint(1, 2)))
            if draw < 0.1:
                some = "<ul>" + "".join(f"<li data-main>{talk(1, 12)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
            elif draw < 0.2:
                some = f"<h2 data-main>{talk(1, 6)}</h2>{some}"
            elif draw < 0.3:
                some = f"<{(t := rnd.choice('blockquote pre figcaption td dd'.split()))} data-main>{talk(2, 25)}</{t}>"
            elif draw < 0.4:
                some = f"<p data-main>{talk(4, 20)} {linked(talk(1, 3))} {talk(4, 20)}</p>"
            elif draw < 0.6 and marked:
                some = f'<div class="{"-".join(rnd.sample(WITHIN, rnd.randint(1, 3)))}">{some}</div>'
            elif draw < 0.7 and marked:
                some += part(rnd.choice([p for p in frame if "ad" in p[2].split() or "related" in p[2] or "share" in p[2] or "newsletter" in p[2]]))
            out.append(some)
        return "".join(out)

    def part(row: tuple, marked: bool = True) -> str:
        label, tags, names, kinds = row
        tag = rnd.choice(tags.split()) if marked else "div"
        words = rnd.sample(names.split(), min(len(names.split()), rnd.choice([1, 1, 2]))) if names and marked and (label or tag in ("div", "section", "ul", "ol", "article") or rnd.random() < 0.5) else []
        words += rnd.sample(["wrapper", "inner", "box", "block", "container", "item", "area"], 1) if marked and rnd.random() < 0.2 else []
        attr = f' {rnd.choice(["class", "class", "id"])}="{rnd.choice([" ", "-", "_"]).join(words)}"' if words else ""
        body = article(marked) if label else filling(rnd.choice(kinds.split()) if marked else "links")
        return f"<{tag}{attr}>{body}</{tag}>" if marked or not label or rnd.random() < 0.5 else body

    def page() -> str:
        marked = rnd.random() < 0.8
        kinds = frame if marked else [p for p in frame if "links" in p[3]]
        fill = [part(rnd.choice(kinds), marked) for _ in range(rnd.choice([0, 0, 1, 2, 3, 4]))] + [part(rnd.choice(main), marked)]
        fill += [part(rnd.choice(kinds), marked) for _ in range(rnd.randint(0, 4))]
        around = f'<div class="{rnd.choice("page wrapper container site layout feature trending main".split())}">' if marked and rnd.random() < 0.3 else ""
        return f"<html><body>{around}{''.join(fill)}</body></html>"

    return [page() for _ in range(n)]


def learnt_names(pages: list[list[Block]], least: int = 3) -> Names:
    """Log odds of every name that least blocks or more stand under."""
    seen = (Counter(), Counter())
    for found in pages:
        for b in found:
            seen[b.label].update({w for e in b.inside + b.outside for w in e.names})
    n = [sum(b.label == y for found in pages for b in found) for y in (0, 1)]
    return Names({w: math.log((seen[1][w] + 0.5) / (n[1] + 1) / ((seen[0][w] + 0.5) / (n[0] + 1))) for w in sorted(seen[0] | seen[1]) if seen[0][w] + seen[1][w] >= least})


@dataclass(frozen=True)
class Extractor:
    """What tells main text: the log odds of names, and the tree over the features."""

    names: Names
    tree: Tree

    @classmethod
    def fit(cls, pages: list[str] | None = None) -> Extractor:
        """Learns from pages whose main blocks carry data-main (by default those of the labelled table, once in a process)."""
        if pages is None:
            return _of_the_table()
        found = [blocks(p, "data-main") for p in pages]
        names = learnt_names(found)
        return cls(names, grow(np.concatenate([features(b, names) for b in found]), np.array([b.label for bs in found for b in bs], float)))

    def main(self, found: list[Block]) -> np.ndarray:
        """Which blocks are main text; a share of one half counts as main text."""
        return self.tree.predict(features(found, self.names)) >= 0.5 if found else np.zeros(0, bool)

    def text(self, page: str | None) -> str:
        """The main text of a page, one line for each block."""
        found = blocks(page) if page else []
        return "\n".join(b.text for b, take in zip(found, self.main(found)) if take)


@cache
def _of_the_table() -> Extractor:
    return Extractor.fit(labelled_pages())


def extract(pages: DataFrame, column: str = "html", extractor: Extractor | None = None) -> DataFrame:
    """pages with text (main text) and n_chars (its code points) from each whole page.

    The extractor is learnt from the labelled table, unless one is given. Null and empty pages
    give empty text; pages of any length and any malformed markup give what can be read. A block of which the tree
    is undecided (a share of one half) is main text. Columns named text and n_chars are replaced; others stay; repeated rows are kept.
    """
    pages = pages.drop("text", "n_chars")
    tool = extractor or Extractor.fit()
    at = pages.columns.index(column)
    names = [*pages.columns, "text", "n_chars"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches):
        for b in batches:
            got = [tool.text(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=names)

    return map_batches(pages, run, f"{fields}, text string, n_chars long")
