"""Main text of web pages by a tree-structured graphical model over the DOM (operator 6)."""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

_NAME = re.compile(r"[^\s/>]+")
#: Attributes up to the end of the tag: > counts only outside of quoted values. Possessive, so each character is read once.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup: it ends with their end tag only, or with the page.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea xmp iframe noembed noframes".split()}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr label "
    "audio video picture object canvas noscript svg math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded semantics annotation".split()
)
#: A start tag of the first kind ends the nearest open element of the others within the same list or table.
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_LISTS = ("ul", "ol", "dl", "table", "select")
_SCOPE = frozenset("article aside body div fieldset footer form header main nav section table td th ul ol dl blockquote figure html".split())
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words of class names by what they hint at: features for the model, which weighs them against everything else.
_HINTS = {w: k for k, words in enumerate((
    "nav navigation navbar menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside widget login search toolbar pagination pager contentinfo complementary navigacion menue fusszeile kopfzeile pied entete pie cabecera",
    "comment comments reply replies discussion disqus kommentar kommentare commentaire commentaires comentario comentarios commenti reacties",
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion anzeige werbung publicite publicidad",
    "cookie cookies consent gdpr banner notice alert popup modal overlay hinweis avis aviso",
    "subscribe newsletter signup share sharing",
    "social related recommended recommendations copyright legal disclaimer tags",
    "article content main post entry story text body maincontent articlebody artikel inhalt contenu contenido contenuto",
)) for w in words.split()}
_TYPES = ("root", "nav", "header", "footer", "aside", "form", "article", "div", "p", "title", "heading", "list", "item", "table", "quote", "other", "leaf")
_TYPE = {t: i for i, t in enumerate(_TYPES)}
_OF = {
    "html": "root", "body": "root", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "select": "form", "datalist": "form", "template": "form", "dialog": "aside", "article": "article", "main": "article",
    "div": "div", "section": "div", "center": "div", "p": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "table": "table", "tbody": "table", "thead": "table", "tr": "table", "td": "table",
    "th": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "h1": "title", **{f"h{i}": "heading" for i in range(2, 7)},
}
_LEAF_FEATURES = 11
#: After those of types and leaves: hints, outside and inside of an article element; an element inside one; beside
#: the last main heading (within the element that holds it); after that element; the element that holds it itself.
_HINT = len(_TYPES) + _LEAF_FEATURES
_INSIDE = _HINT + 2 * (max(_HINTS.values()) + 1)
_BESIDE, _AFTER, _HOLDS = _INSIDE + 1, _INSIDE + 2, _INSIDE + 3
FEATURES = _HOLDS + 1


def _hints(attributes: str, inside: bool) -> tuple[int, ...]:
    """Features of an element's class, id, role and label, told apart by whether it is inside an article element."""
    found = set()
    for m in _NAMED.finditer(attributes):
        found.update(_HINTS.get(w, -1) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()))
    found.discard(-1)
    return (*(_HINT + 2 * k + inside for k in sorted(found)), *((_INSIDE,) if inside else ()))


class Page:
    """The DOM of one page: parents before children; leaves are text blocks in page order.

    Block elements and text blocks are nodes; inline markup only bears on the share of linked text. Scripts,
    styles, titles, text areas and comments are left out; the model judges all other text. Unclosed elements
    end with their container. Each character is read a bounded number of times.
    """

    __slots__ = ("depth", "features", "inside", "leaves", "parent", "texts", "types")

    def __init__(self, source: str):
        self.parent, self.types, self.depth, self.features, self.leaves, self.texts = [-1], [0], [0], [(0,)], [], []
        self.inside = [False]
        self._read(source)

    def _node(self, parent: int, kind: int, extra: tuple = ()) -> int:
        self.parent.append(parent)
        self.types.append(kind)
        self.depth.append(self.depth[parent] + 1)
        self.inside.append(self.inside[parent] or kind == _TYPE["article"])
        self.features.append((kind, *extra))
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # tag, its block node
        opened: dict[str, list[int]] = defaultdict(list)  # tag -> its places in the stack
        scopes: list[int] = []  # places of the elements that an open paragraph can't reach beyond
        held: list[str] = []
        linked, links = 0, 0
        titled = None  # (place, node) of the element that holds the last main heading

        def position() -> tuple[int, ...]:
            if titled is None:
                return ()
            return (_BESIDE if titled[0] < len(stack) and stack[titled[0]][1] == titled[1] else _AFTER,)

        def flush():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    share = min(1.0, linked / len(text))
                    n = len(text)
                    extra = (
                        len(_TYPES) + (0 if n < 20 else 1 if n < 60 else 2 if n < 200 else 3),
                        len(_TYPES) + 4 + (0 if share < 0.1 else 1 if share < 0.7 else 2),
                        len(_TYPES) + 7 + (text[-1] in ".!?…。»\"”"),
                        *((len(_TYPES) + 9,) if "©" in text[:80] else ()),
                        *((len(_TYPES) + 10,) if text.count(" ") < 3 else ()),
                        *position(),
                    )
                    self.leaves.append(self._node(stack[-1][1], _TYPE["leaf"], extra))
                    self.texts.append(text)
                linked = 0

        def end(place: int) -> None:
            """Ends the element at this place of the stack and all within it."""
            for tag, _ in reversed(stack[place:]):
                opened[tag].pop()
                if tag in _SCOPE:
                    scopes.pop()
            del stack[place:]

        def last(tags) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        for part, close, tag, attributes in _tokens(source):
            if part:
                part = htmllib.unescape(part) if "&" in part else part
                held.append(part)
                if links:
                    linked += len(part.strip())
            if tag in ("br", "hr", "img") and not close:
                held.append(" ")
            if tag == "a":
                links = 0 if close else 1
            if not tag or tag in _INLINE or tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            if tag in ("html", "head", "body"):
                continue
            links = 0
            if close:
                place = last((tag,))
                if place and not (tag == "p" and scopes and scopes[-1] > place):
                    end(place)
                continue
            if tag in _CLOSED_BY:
                place, bound = last(_CLOSED_BY[tag][:1]) or last(_CLOSED_BY[tag]), last(_LISTS)
                place = place if place > bound else last(_CLOSED_BY[tag])
                if place > bound:
                    end(place)
            elif tag in _OF:  # a block ends an open paragraph, and a form control that was left open
                place = last(("select", "p"))
                if place and not (scopes and scopes[-1] > place):
                    end(place)
            if not attributes.endswith("/"):
                opened[tag].append(len(stack))
                if tag in _SCOPE:
                    scopes.append(len(stack))
                parent = stack[-1][1]
                if tag == "h1":
                    place = len(stack) - 1 - (stack[-1][0] in ("header", "hgroup"))
                    titled = place, stack[place][1]
                    self.features[titled[1]] = (*(x for x in self.features[titled[1]] if x != _HOLDS), _HOLDS)
                stack.append((tag, self._node(parent, _TYPE[_OF.get(tag, "other")], (*_hints(attributes, self.inside[parent]), *position()))))
        flush()


def _tokens(source: str):
    """(text before a tag, is it an end tag, its name or empty, its attributes), in one pass over the page.

    Comments and declarations end as HTML has it, or with the page; so do elements whose content is no
    markup (scripts, styles, titles, text areas). A < that begins no tag is text; so is one without any >
    behind it. Where a quote is never closed, tags end at the next >, whatever quotes say.
    """
    at, held, strict, last = 0, [], True, source.rfind(">")
    while True:
        begin = source.find("<", at)
        if begin < 0 or (last < begin and not source.startswith(("<!", "<?"), begin)):
            held.append(source[at:])
            yield "".join(held), False, "", ""
            return
        held.append(source[at:begin])
        if source.startswith("<!--", begin):
            done = begin + 4 if source.startswith((">", "->"), begin + 4) else source.find("-->", begin + 4)
            at = source.find(">", done) + 1 if done >= 0 else len(source)
            continue
        if source.startswith(("<!", "<?"), begin):
            at = source.find(">", begin) + 1 or len(source)
            continue
        close = source.startswith("/", begin + 1)
        first = source[begin + 1 + close : begin + 2 + close]
        if not (first.isascii() and first.isalpha()):
            if close:  # a bogus comment
                at = source.find(">", begin) + 1
            else:
                held.append("<")
                at = begin + 1
            continue
        name = _NAME.match(source, begin + 1 + close)
        finish = -1
        if strict:
            finish = _ATTRIBUTES.match(source, name.end()).end()
            strict = finish < len(source)
        finish = finish if strict and source.startswith(">", finish) else source.find(">", name.end())
        tag, attributes = name[0].lower(), source[name.end() : finish]
        at = finish + 1
        yield "".join(held), close, tag, attributes
        held.clear()
        if not close and tag in _RAW and not attributes.endswith("/"):
            done = _RAW[tag].search(source, at)
            at = len(source) if done is None else max(source.find(">", done.end()) + 1, done.end())


class Forest:
    """Several pages as arrays, so that messages pass for all of them at once, depth by depth."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.parent) for p in pages])
        first = np.cumsum(size) - size
        self.roots = first
        self.parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=True)])
        self.parent[first] = -1
        self.types = np.concatenate([p.types for p in pages])
        self.depth = np.concatenate([p.depth for p in pages])
        count = np.array([len(f) for p in pages for f in p.features])
        self.active = np.array([x for p in pages for f in p.features for x in f])
        self.starts = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(count)), count)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        self.pair = self.types[self.parent] * len(_TYPES) + self.types


class TreeModel:
    """Binary states (1: content). Log potentials: unary (features x 2) and by types of parent and child (x 2 x 2)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """Sum-product, upward then downward: P(state) of each node, P(parent's state, own state), log Z."""
        own = np.add.reduceat(self.unary[f.active], f.starts, axis=0)
        edge = self.pair[f.pair]
        up = own.copy()
        message = np.zeros_like(own)  # from a node to its parent
        for level in reversed(f.levels[1:]):
            both = edge[level] + up[level][:, None, :]
            message[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, f.parent[level], message[level])
        down = np.zeros_like(own)
        joint = np.zeros((len(own), 2, 2))
        belief = up.copy()
        for level in f.levels[1:]:
            p = f.parent[level]
            rest = belief[p] - message[level]  # what the parent believes without this child
            both = edge[level] + rest[:, :, None]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            belief[level] = up[level] + down[level]
            joint[level] = both + up[level][:, None, :]
        z = np.logaddexp(belief[:, 0], belief[:, 1])
        child = f.parent >= 0
        joint[child] = np.exp(joint[child] - z[child, None, None])
        return np.exp(belief - z[:, None]), joint, float(z[f.roots].sum())


def labelled_pages(n: int, seed: int, foreign: float = 0.0, named: float = 0.0) -> list[tuple[str, list[bool]]]:
    """Labelled training pages: layouts drawn from a small grammar, with the label of each text block in page order.

    foreign: the share of pages whose class names say nothing; named: the share of an article's blocks whose names
    hint at something else (and, where above 0, some site headers hold a main heading of their own).
    """
    d = np.random.default_rng(seed)
    pick = lambda *x: x[int(d.integers(0, len(x)))]
    words = lambda a, b: " ".join("".join(map(chr, d.integers(97, 123, d.integers(2, 9)))) for _ in range(d.integers(a, b)))

    def page() -> tuple[str, list[bool]]:
        out, labels, hidden = [], [], d.random() < foreign

        def renamed(source: str) -> str:
            """Random class names and ids, but those of comments: nothing else tells a comment from a text."""
            told = lambda m: m[0] if _HINTS.get(re.split(r"[^a-z]", m[3])[0]) == _HINTS["comments"] else f"{m[1]}={m[2]}{words(1, 2)}{m[2]}"
            return re.sub(r"(class|id)=([\"'])([^\"']*)\2", told, source) if hidden else source

        def text(s: str, good: bool) -> str:
            labels.append(good)
            return s

        def bad_block() -> None:
            kind = pick("nav", "menu", "header", "footer", "aside", "ad", "cookie", "form", "comments", "related", "share")
            if kind in ("nav", "menu"):
                out.append(f"<{pick('nav', 'div class="menu"', 'ul class="nav"')}><ul>".replace('<ul class="nav"><ul>', '<ul class="nav">'))
                out.extend(f'<li><a href="/x">{text(words(1, 3), False)}</a></li>' for _ in range(d.integers(2, 7)))
                out.append("</ul></nav></div>")
            elif kind == "comments":
                out.append(pick('<section id="comments">', '<div class="comments">', '<div class="comment-list">', '<div class="kommentare">'))
                for _ in range(d.integers(1, 4)):
                    out.append(f"<div class='{pick('comment', 'reply', 'x')}'><p>{text(words(4, 40).capitalize() + '.', False)}</p></div>")
                out.append("</section></div>")
            elif kind == "form":
                out.append(f"<form><label>{text(words(1, 4) + '</label> <input> ' + words(1, 2), False)}</form>")
            else:
                own = {"header": 'div class="header"', "footer": 'div id="footer"', "aside": 'div class="sidebar"', "ad": 'div class="ad"', "cookie": 'div class="cookie-notice"', "related": 'div class="related"', "share": 'div class="share"'}[kind]
                tag = pick(own, kind if kind in ("header", "footer", "aside") else own, 'div class="banner"', 'div class="promo"', 'div class="notice"')
                out.append(f"<{tag}>")
                if named and kind == "header" and d.random() < 0.15:  # the name of the site
                    out.append(f"<h1>{text(words(1, 4), False)}</h1>")
                elif d.random() < 0.4:
                    out.append(text(("&copy; " if kind == "footer" else "") + words(2, 14) + pick(".", ""), False))
                else:
                    for _ in range(d.integers(1, 4)):
                        out.append(pick("<p>{}</p>", '<div><a href="#">{}</a></div>', "<h3>{}</h3>").format(text(words(2, 14) + pick(".", ""), False)))
                out.append(f"</{tag.split()[0]}>")

        def good_block() -> None:
            r = d.random()
            if r < 0.12:
                out.append(f"<h{pick(2, 3)}>{text(words(1, 9), True)}</h2></h3>")
            elif r < 0.22:
                out.append("<ul>")
                out.extend(f"<li>{text(words(1, 16), True)}</li>" for _ in range(d.integers(2, 5)))
                out.append("</ul>")
            elif r < 0.28:
                out.append(f"<blockquote>{text(words(3, 30), True)}</blockquote>")
            elif r < 0.40:
                out.append(pick("<p></p>{}<p></p>", "<div>{}</div>").format(text(words(1, 30) + pick(".", ""), True)))
            elif r < 0.46:
                out.append(f"<table><tr><td>{text(words(1, 6), True)}</td><td>{text(words(1, 6), True)}</td></tr></table>")
            elif r < 0.46 + named:  # the article's own part with a name that hints elsewhere
                name = pick("social", "alert", "related-work", "legal", "notice", "tags", "header", "share", "search", "box", "note", "highlight")
                out.append(f'<{pick("div", "section")} class="{name}">' if d.random() < 0.6 else f"<ul class='{name}'><li>")
                for _ in range(d.integers(1, 3)):
                    out.append(f"<p>{text(words(6, 50).capitalize() + '.', True)}</p>")
                out.append("</li></ul></div></section>")
            else:
                s = words(1, 60).capitalize() + pick(".", ".", ".", "!", "")
                out.append(pick("<p>{}</p>", "<p>{}", "<p><b>{}<br>", '<p>{} <a href="#">x</a></p>').format(text(s, True)))

        for _ in range(d.integers(0, 5)):
            bad_block()
        wrap = pick("article", "article", "main", 'div class="content"', 'div id="post"', "div", "section", "")
        out.append(f"<{wrap}>" if wrap else "")
        if d.random() < 0.8:
            out.append(f"<h1>{text(words(1, 12), True)}</h1>")
        for _ in range(d.integers(1, 9)):
            good_block()
            if d.random() < 0.12:
                out.append("</p>")
                bad_block()
        out.append(f"</{wrap.split()[0]}>" if wrap else "</p>")
        for _ in range(d.integers(0, 4)):
            bad_block()
        return "<html><head><title>t</title><script>var a = '<p>';</script></head><body>" + renamed("".join(out)) + pick("</body></html>", ""), labels

    return [page() for _ in range(n)]


@lru_cache(maxsize=2)
def train(n: int = 400, rounds: int = 150, seed: int = 5, ridge: float = 0.02) -> TreeModel:
    """Maximum likelihood on n labelled pages (half of them with class names that say nothing), by gradient ascent on expected against observed counts.

    An element is labelled content if a text block below it is.
    """
    pages, states = [], []
    for source, labels in labelled_pages(n, seed, foreign=0.5, named=0.16):
        p = Page(source)
        if len(p.leaves) != len(labels):
            continue
        s = np.zeros(len(p.parent), np.int64)
        for leaf, good in zip(p.leaves, labels, strict=True):
            k = leaf
            while good and k >= 0:
                s[k] = 1
                k = p.parent[k]
        pages.append(p)
        states.append(s)
    if len(pages) < 0.9 * n:
        raise RuntimeError("labelled pages do not match their labels")
    f, s = Forest(pages), np.concatenate(states)
    model = TreeModel(np.zeros((FEATURES, 2)), np.zeros((len(_TYPES) ** 2, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen_u, seen_p = np.zeros_like(model.unary), np.zeros_like(model.pair)
    np.add.at(seen_u, (f.active, s[f.owner]), 1)
    np.add.at(seen_p, (f.pair[child], s[f.parent[child]], s[child]), 1)
    g_u, g_p = np.full_like(seen_u, 1e-6), np.full_like(seen_p, 1e-6)
    for _ in range(rounds):
        p, joint, _ = model.marginals(f)
        up_u, up_p = seen_u - ridge * model.unary, seen_p - ridge * model.pair
        np.subtract.at(up_u, f.active, p[f.owner])
        np.subtract.at(up_p, f.pair[child], joint[child])
        g_u += up_u**2
        g_p += up_p**2
        model.unary = model.unary + 0.4 * up_u / np.sqrt(g_u)
        model.pair = model.pair + 0.4 * up_p / np.sqrt(g_p)
    return model


def extract(sources: list[str], model: TreeModel) -> list[str]:
    """The main text of each page: its content blocks in page order, joined by line feeds."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    f = Forest(pages)
    p = model.marginals(f)[0][:, 1]
    out = []
    for page, first in zip(pages, f.roots.tolist(), strict=True):
        out.append("\n".join(t for leaf, t in zip(page.leaves, page.texts, strict=True) if p[first + leaf] >= 0.5))
    return out


def main_text(pages: DataFrame, model: TreeModel) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars): one row for each row.

    Null or empty html gives an empty text. White space within a block becomes one space. Repeated rows keep
    one row each, null ids and urls stay null, an empty table gives no rows; other columns are not read.
    Pages pass in portions of about 4 million characters; the work is linear in the page.
    """

    def run(batches):
        for b in batches:
            source, out, at = text_column(b, "html"), [], 0
            while at < len(source):
                to, size = at, 0
                while to < len(source) and (to == at or size < 4_000_000) and to - at < 512:
                    size += len(source[to])
                    to += 1
                out += extract(source[at:to], model)
                at = to
            cols = [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), train())
