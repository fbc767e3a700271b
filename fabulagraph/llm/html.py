"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements.  Each has one of three states: a wrapper that may
hold anything, content, or boilerplate.  Parent-child potentials (by the child's tag) and
unary potentials (by class and id names and link density) are trained by counting over
labelled pages; messages of the sum-product algorithm go up and down the tree once and give
every element's exact marginals.  Text whose element is more likely content than not is
kept, in blocks.

The labelled pages are written by ``labelled_pages`` from a seeded grammar of page parts,
with the true state of each part in an attribute that features don't see.

Nulls and edges: a null or empty html gives an empty text; cut-off pages are read as far as
they go, an unfinished tag or comment at the end is dropped; text of controls is no content, and what
follows one without an end tag is read on from the next block; unknown tags are wrappers like
others; repeated rows are extracted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulagraph.llm.store import map_texts

WRAPPER, CONTENT, BOILER = range(3)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    # a quote counts after an equals sign alone, and only if it ends somewhere
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>"
    r"|</?[a-zA-Z][^<]*+\Z",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|data-fabulagraph-state)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_NAME = re.compile(r"[^\s]+")
_PART = re.compile(r"[a-z]+")

#: Fixed lists of HTML: elements without content, with text that isn't shown as text, and within lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
#: Of them, those whose text is markup: without an end tag they hide nothing.
MARKUP = frozenset("noscript template".split())
#: Controls and drawings: their text isn't the page's, and where their end tag is missing a block ends them.
CONTROLS = frozenset("svg select datalist option optgroup button".split())
BLOCK = frozenset("address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STATE = "data-fabulagraph-state"


class Page:
    """Elements in page order (a parent before its children) and pieces of text.

    ``pieces`` are (element, block number, text, whether in a link).
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.names, self.states = ["html"], [0], [()], [None]
        self.pieces: list[tuple[int, int, str, bool]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        block, links, at, n = 0, 0, 0, len(html)
        mute, loose = 0, False  # where in the stack the outermost control is, and whether it has no end tag
        while at < n:
            m = _TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if mute >= len(stack):
                mute = 0
            if text and not mute:
                self.pieces.append((stack[-1][1], block, text, links > 0))
            if m is None:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if mute and loose and tag in BLOCK and not m[1]:
                del stack[mute:]
                mute = 0
            if tag == "br" and not mute:
                self.pieces.append((stack[-1][1], block, " ", False))
            if tag in VOID:
                block += tag == "hr"
                continue
            if tag == "a":
                links = 0 if m[1] else 1
            inline = tag in INLINE
            block += not inline
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if inline and stack[i][0] not in INLINE or tag == "p" and i == mute:
                        break
                continue
            if m[3].endswith("/") and (tag == "svg" or mute and any(x == "svg" for x, _ in stack[mute:])):
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if end is None and tag in MARKUP:
                    continue
                close = html.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else n
                continue
            if mute or tag in CONTROLS:
                if not mute:
                    mute = len(stack)
                    end = re.compile(f"</?{tag}(?=[\\s/>])", re.I).search(html, at)
                    loose = end is None or end[0][1] != "/"
                if not inline:
                    stack.append((tag, stack[-1][1]))
                continue
            names, state = self._named(m[3])
            if inline and not names:
                continue
            if not inline:
                over = CLOSES.get(tag)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or over and stack[i][0] in over:
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            self.tags.append(tag)
            self.parents.append(stack[-1][1])
            self.names.append(names)
            self.states.append(state)
            stack.append((tag, len(self.tags) - 1))

    @staticmethod
    def _named(attributes: str) -> tuple[tuple[str, ...], int | None]:
        if not attributes or "=" not in attributes and "hidden" not in attributes:
            return (), None
        names, state = set(), None
        for key, *values in _NAMED.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == STATE:
                state = int(value) if value in ("0", "1", "2") else None
            else:
                for name in _NAME.findall(value):
                    # what comes before a word that isn't known from names of parts of pages describes something else
                    for part in reversed(_PART.findall(name)):
                        names.add(part)
                        if part not in KNOWN and len(part) > 2:
                            break
        if _HIDDEN.search(attributes):
            names.add("hidden")
        return tuple(sorted(names)), state

    def features(self) -> list[list[str]]:
        """Of each element: names, and how much of its own text is links."""
        own, linked = [0] * len(self.tags), [0] * len(self.tags)
        for e, _, text, link in self.pieces:
            size = len(text.strip())
            own[e] += size
            linked[e] += size * link
        return [
            [f"name={x}" for x in names] + ([f"links={min(3, 4 * linked[e] // own[e])}"] if own[e] else [])
            for e, names in enumerate(self.names)
        ]


def _kind(tag: str) -> str:
    return "inline" if tag in INLINE else tag


class Model:
    """Potentials, counted over labelled pages with additive smoothing."""

    def __init__(self, pages: list[str]):
        pairs: dict[str, list[list[float]]] = {}
        every = [[1.0] * 3 for _ in range(3)]
        given: list[Counter] = [Counter() for _ in range(3)]
        for html in pages:
            page = Page(html)
            states: list[int] = []
            for e, parent in enumerate(page.parents):
                above = states[parent] if e else WRAPPER
                own = page.states[e]
                states.append(own if own is not None else above)
                if e:
                    kind = _kind(page.tags[e])
                    pairs.setdefault(kind, [[0.0] * 3 for _ in range(3)])[above][states[e]] += 1
                    every[above][states[e]] += 1
            for e, found in enumerate(page.features()):
                given[states[e]].update(set(found))
                given[states[e]][""] += 1
        smooth = [[5 * x / sum(row) for x in row] for row in every]
        self.pairs = {
            k: [[(t[a][b] + smooth[a][b]) / (sum(t[a]) + 5) for b in range(3)] for a in range(3)] for k, t in pairs.items()
        }
        self.other = [[x / sum(row) for x in row] for row in every]
        seen = set().union(*given) - {""}
        rate = {f: [(given[s][f] + 0.05) / (given[s][""] + 0.1) for s in range(3)] for f in seen}
        self.unary = {f: [r / max(v) for r in v] for f, v in rate.items()}

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of every element: messages up, then down."""
        n = len(page.tags)
        tables = [self.pairs.get(_kind(t), self.other) for t in page.tags]
        belief = []
        for found in page.features():
            b = [1.0, 1.0, 1.0]
            for f in found:
                if u := self.unary.get(f):
                    b = [b[0] * u[0], b[1] * u[1], b[2] * u[2]]
            total = b[0] + b[1] + b[2]
            belief.append([b[0] / total, b[1] / total, b[2] / total])
        belief[0] = [1.0, 0.02, 0.001]
        ups: list = [None] * n
        parents = page.parents
        for e in range(n - 1, 0, -1):
            b, t = belief[e], tables[e]
            up = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in t]
            ups[e] = up
            p = belief[parents[e]]
            p = [p[0] * up[0], p[1] * up[1], p[2] * up[2]]
            total = p[0] + p[1] + p[2]
            belief[parents[e]] = [p[0] / total, p[1] / total, p[2] / total] if total else [1.0, 1e-9, 1e-9]
        total = sum(belief[0])
        full = [[x / total for x in belief[0]]]
        for e in range(1, n):
            above, up, t, b = full[parents[e]], ups[e], tables[e], belief[e]
            rest = [above[s] / up[s] if up[s] else 0.0 for s in range(3)]
            f = [b[c] * (rest[0] * t[0][c] + rest[1] * t[1][c] + rest[2] * t[2][c]) for c in range(3)]
            total = f[0] + f[1] + f[2]
            full.append([f[0] / total, f[1] / total, f[2] / total] if total else [1.0, 0.0, 0.0])
        return [f[CONTENT] for f in full]

    def extract(self, html: str | None) -> str:
        """Blocks of content in page order, joined by blank lines."""
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        blocks: list[list[str]] = []
        last = -1
        for e, block, text, _ in page.pieces:
            if content[e] > 0.5:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
        return "\n\n".join(x for x in lines if x)


#: Names of classes and ids in the labelled pages, by state.
_NAMES = {
    WRAPPER: "page wrapper container row site layout inner outer grid wrap col root app body".split(),
    CONTENT: "article content post entry story main text body prose markdown hentry".split(),
    "nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs pagination links tabs".split(),
    "header": "header masthead banner top logo branding site".split(),
    "footer": "footer bottom copyright colophon legal site".split(),
    "side": "sidebar side widget related recommended popular aside toc tags secondary".split(),
    "note": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup toast disclaimer".split(),
    "ad": "ad ads advert advertisement sponsored promo promoted sponsor banner adbox commercial".split(),
    "talk": "comments comment reply replies discussion respond responses disqus thread commentlist".split(),
    "share": "share social sharing buttons likes follow toolbar meta byline".split(),
    "form": "form search login contact signin field".split(),
}


#: Words that say where a part is, or what sort of box, in the names of parts.
_BOXES = (
    "left right top bottom inner outer upper lower box area section block container wrapper wrap holder panel bar row col column grid group "
    "list item items posts articles stories news links link content body text title label icon button btn module component region slot unit "
    "zone message sticky fixed mobile desktop small large new js main page site primary secondary the"
).split()
KNOWN = frozenset(_BOXES).union(*_NAMES.values())


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages of random parts, with the true state of a part in ``STATE`` where it changes."""
    rng = random.Random(seed)

    def prose() -> str:
        words = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.choice((1, 2, 4, 8, 15, 30, 60)))]
        if rng.random() < 0.15:
            k = rng.randrange(len(words))
            words[k] = f'<a href="/x">{words[k]}</a>'
        if rng.random() < 0.2:
            words[0] = f"<b>{words[0]}</b>"
        return " ".join(words)

    def named(kind, p: float = 0.85) -> str:
        if rng.random() > p:
            return ""
        return f' {rng.choice(("class", "id"))}="{rng.choice("x site js main the left right box".split()) + "-" if rng.random() < 0.2 else ""}{rng.choice(_NAMES[kind])}{"-" + rng.choice(_BOXES) if rng.random() < 0.15 else ""}"'

    def listed(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose()[:9]}</a></li>' for i in range(k)) + "</ul>"

    def junk(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        tag = tag if tag and rng.random() < 0.7 else rng.choice(("div", "div", "section"))
        name = named(kind, 0.4 if tag not in ("div", "section") else 1.0)
        inner = {
            "nav": lambda: listed(rng.randint(2, 7)),
            "header": lambda: f"<h1>{prose()[:30]}</h1>" + (listed(3) if rng.random() < 0.5 else ""),
            "footer": lambda: rng.choice((f"&copy; {prose()}", f"<p>{prose()}</p>", listed(3))),
            "side": lambda: f"<h3>{prose()[:20]}</h3>" + rng.choice((listed(4), f"<p>{prose()}</p>")),
            "note": lambda: rng.choice((prose(), f"<p>{prose()}</p>")),
            "ad": lambda: rng.choice((prose(), f"<p>{prose()}</p>", f'<a href="/ad">{prose()}</a>')),
            "talk": lambda: f"<h2>{prose()[:12]}</h2>" + "".join(f'<div{named("talk", 0.6)}><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))),
            "share": lambda: rng.choice((listed(3), prose()[:20])),
            "form": lambda: f"<label>{prose()[:10]}</label><input><p>{prose()}</p>",
        }[kind]()
        return f'<{tag}{name} data-fabulagraph-state="2">{inner}</{tag}>'

    def parts(k: int) -> str:
        out = []
        for _ in range(k):
            r = rng.random()
            end = "</p>" if rng.random() < 0.8 else ""
            if r < 0.70:
                out.append(f"<p>{prose()}{end}")
            elif r < 0.79:
                out.append("<h{0}>{1}</h{0}>".format(rng.randint(2, 4), prose()[:40]))
            elif r < 0.83:
                out.append("<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.86:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif r < 0.88:
                out.append(f"<table><tr><td>{prose()}</td><td>{prose()}</td></tr></table>")
            elif r < 0.90:
                out.append(f"<div>{prose()}</div><div class='{rng.choice(_NAMES[CONTENT])}-{rng.choice(("body", "text", "box", "area", "section", "block", "inner"))}'><p>{prose()}</p></div><pre>{prose()}</pre><figure><figcaption>{prose()}</figcaption></figure>")
            elif r < 0.93:
                out.append(f"<section><h2>{prose()[:30]}</h2><p>{prose()}</p><p>{prose()}</p></section>")
            else:
                out.append(junk(rng.choice(("ad", "share", "side", "form", "footer", "note", "talk", "nav"))))
        return "".join(out)

    pages = []
    for _ in range(n):
        ahead = "".join(junk(k) for k in ("header", "nav", "ad", "note") if rng.random() < 0.6)
        behind = "".join(junk(k) for k in ("side", "ad", "talk", "form", "note", "share", "footer") if rng.random() < 0.5)
        title = f"<h1>{prose()[:60]}</h1>" if rng.random() < 0.8 else ""
        if title and rng.random() < 0.2:
            title = f"<header>{title}<p>{prose()}</p></header>"
        r = rng.random()
        if r < 0.85 and title.startswith("<h1") and rng.random() < 0.25:
            tag, name = rng.choice(("div", "section", "header")), f'{rng.choice(_NAMES[CONTENT])}-{rng.choice(("header", "head", "title"))}'
            title = f'<{tag} class="{name}">{title}<p>{prose()}</p></{tag}>'
        if r < 0.5:
            main = f'<article{named(CONTENT, 0.3)} data-fabulagraph-state="1">{title}{parts(rng.randint(1, 9))}</article>'
        elif r < 0.65:
            main = f'<main data-fabulagraph-state="1">{title}{parts(rng.randint(1, 9))}</main>'
        elif r < 0.85:
            main = f'<div{named(CONTENT, 1.0)} data-fabulagraph-state="1">{title}{parts(rng.randint(1, 9))}</div>'
        else:
            main = re.sub(r"<(p|h1|ul|blockquote|table)>", r'<\1 data-fabulagraph-state="1">', title + "".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 6))))
        if rng.random() < 0.25:
            main = f"<main>{main}</main>" if r < 0.5 else f"<section>{main}</section>"
        body = ahead + main + behind
        if rng.random() < 0.4:
            body = f"<div{named(WRAPPER)}>{body}</div>"
        pages.append(f"<html><head><title>x</title></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(labelled_pages())


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and ``text`` of every page; ``html`` is read whole."""
    rows = pages.select(*keep, "html")
    schema = rows.withColumnRenamed("html", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            texts = [model.extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_texts(rows, run, schema)


def op2(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
