"""Main-text extraction (operator 7): a linear-chain CRF over a page's leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each
block has features of its ancestor tags and their class words, and of its text;
two labels (boilerplate, main) form a chain in page order. Weights are fitted by
maximum likelihood (forward-backward) on labelled pages, which `training_pages`
composes from page parts in many layouts; pages are decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Pages composed for fitting, passes over them, step and L2 weight.
TRAIN_PAGES, EPOCHS, RATE, L2, SEED = 500, 12, 0.1, 1e-4, 7

_TAG = r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*>"""
_TOKEN, _TOKEN_NO_COMMENT = re.compile("<!--.*?-->|" + _TAG, re.S), re.compile(_TAG, re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|type)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")

# HTML's void elements, those whose content is no text of the page (forms' fields, scripts, styles, the head's title), and inline elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub".split())
#: Elements that close an open one of their own kind, and those that such a search does not leave.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset(("ul", "ol", "dl", "table", "div", "section", "article", "body"))


class Place:
    """The open elements around a block. A place shares the sets of the one outside it unless its element adds to them."""

    __slots__ = ("tags", "marks", "leaf", "hidden", "_names")

    def __init__(self, tags: frozenset = frozenset(), marks: frozenset = frozenset(), leaf: str = "", hidden: bool = False, names: tuple[str, ...] | None = None):
        self.tags, self.marks, self.leaf, self.hidden, self._names = tags, marks, leaf, hidden, names

    def inside(self, tag: str, marks: list[str], hidden: bool) -> Place:
        """The place within a further element; inline elements without class words leave no trace but being hidden."""
        if tag in INLINE and not marks:
            return self if self.hidden or not hidden else Place(self.tags, self.marks, self.leaf, True, self._names)
        tags = self.tags if tag in self.tags else self.tags | {tag}
        own = self.marks if self.marks.issuperset(marks) else self.marks.union(marks)
        return Place(tags, own, tag, self.hidden or hidden, self._names if tags is self.tags and own is self.marks else None)

    @property
    def names(self) -> tuple[str, ...]:
        if self._names is None:
            self._names = (*("in:" + t for t in sorted(self.tags)), *("mark:" + m for m in sorted(self.marks)))
        return self._names


@dataclass
class Block:
    text: str
    place: Place
    linked: int = 0


@dataclass
class _Open:
    tag: str
    place: Place


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; RAW elements and comments hold no text.

    Unclosed elements end with an enclosing one; stray end tags are ignored, and
    a `<` that opens no tag is text. known: feature names besides which elements
    and class words need not be told apart, so that what a block carries is
    bounded however deep it lies.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter = Counter()
    here = Place()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, here, linked))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if opened["a"]:
                linked += len(text)

    def close(k: int) -> None:
        """Close the k-th open element and those within."""
        nonlocal here
        for o in stack[k:]:
            opened[o.tag] -= 1
        del stack[k:]
        here = stack[-1].place if stack else Place()

    at, n, last_comment, last_tag = 0, len(page), page.rfind("-->"), page.rfind(">")
    while at < n:
        m = (_TOKEN if at <= last_comment else _TOKEN_NO_COMMENT).search(page, at) if at <= last_tag else None
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            # Its end tag is the first by name, up to the next >; both are looked for once.
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                at = (page.find(">", end.end()) + 1 if end else 0) or n
            continue
        if tag not in INLINE:
            flush()
            if any(opened[t] for t in SIBLINGS.get(tag, ())):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in SIBLINGS[tag]:
                        close(k)
                        break
                    if stack[k].tag in _HOLDS:
                        break
        if tag not in VOID and not m[3].endswith("/"):
            marks, hidden = [], False
            for a in _ATTR.finditer(m[3]):
                name, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                if name in ("class", "id", "role"):
                    marks += _WORD.findall(value)
                hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
            if known is not None:
                marks = [x for x in marks if "mark:" + x in known]
            here = here.inside(tag if known is None or "in:" + tag in known or "leaf:" + tag in known else "?", marks, hidden)
            opened[tag] += 1
            stack.append(_Open(tag, here))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of every block: its text's, then its place's."""
    return [[*own, *b.place.names, *(["leaf:" + b.place.leaf] if b.place.leaf else [])] for b, own in zip(page, text_features(page))]


def text_features(page: list[Block]) -> list[list[str]]:
    out, n = [], len(page)
    for k, b in enumerate(page):
        size = len(b.text)
        words = b.text.count(" ") + 1
        f = ["bias", f"len{min(7, size.bit_length() - 1)}" if size < 256 else "len8", f"words{min(6, words.bit_length())}"]
        share = b.linked / size
        f.append("link" + ("0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"))
        f.append("end." if b.text[-1] in ".!?…\"'”)" else "end-")
        if k == 0:
            f.append("first")
        if k == n - 1:
            f.append("last")
        if re.search("©|copyright|all rights reserved", b.text[:200], re.I):
            f.append("copyright")
        if "|" in b.text or "·" in b.text or "›" in b.text:
            f.append("divider")
        if b.place.hidden:
            f.append("hidden")
        out.append(f)
    return out


@dataclass
class Crf:
    """weights: feature -> (boilerplate, main); steps: transition scores by (from, to)."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    steps: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def __post_init__(self):
        self.known = frozenset(self.weights)

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        """Per block the weights of its features by label; those of a place are added up once."""
        get, places, out = self.weights.get, {}, []

        def total(names) -> tuple[float, float]:
            a = b = 0.0
            for name in names:
                if w := get(name):
                    a += w[0]
                    b += w[1]
            return a, b

        for b, own in zip(page, text_features(page)):
            key = id(b.place)
            if key not in places:
                places[key] = total([*b.place.names, "leaf:" + b.place.leaf])
            x, y = places[key], total(own)
            out.append((x[0] + y[0], x[1] + y[1]))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi; on ties boilerplate."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.steps
        back, (a, b) = [], (0.0, 0.0)
        for k, (x, y) in enumerate(self.scores(page)):
            if k == 0:
                a, b = x, y
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        at = int(b > a)
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = SEED) -> Crf:
    """Maximum likelihood by stochastic gradients (AdaGrad), one page a step."""
    names = sorted({f for page, _ in pages for fs in features(page) for f in fs})
    at = {f: k for k, f in enumerate(names)}
    data = [([np.array([at[f] for f in fs]) for fs in features(page)], np.array(y)) for page, y in pages if page]
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full((len(names), 2), 1e-2), np.full((2, 2), 1e-2)
    order = list(range(len(data)))
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            fs, y = data[i]
            n = len(y)
            s = np.array([w[f].sum(axis=0) for f in fs])
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for k in range(1, n):
                fwd[k] = np.logaddexp(fwd[k - 1, 0] + t[0], fwd[k - 1, 1] + t[1]) + s[k]
            for k in range(n - 2, -1, -1):
                x = s[k + 1] + bwd[k + 1]
                bwd[k] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
            z = np.logaddexp(fwd[-1, 0], fwd[-1, 1])
            err = -np.exp(fwd + bwd - z)
            err[np.arange(n), y] += 1
            dt = np.zeros((2, 2))
            if n > 1:
                pair = fwd[:-1, :, None] + t[None] + (s[1:] + bwd[1:])[:, None, :] - z
                dt -= np.exp(pair).sum(axis=0)
                np.add.at(dt, (y[:-1], y[1:]), 1)
            for f, e in zip(fs, err):
                g = e - l2 * w[f]
                gw[f] += g * g
                w[f] += rate * g / np.sqrt(gw[f])
            gt += dt * dt
            t += rate * dt / np.sqrt(gt)
    return Crf({f: (float(w[k, 0]), float(w[k, 1])) for f, k in at.items()}, tuple(map(tuple, t.tolist())))


def training_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> Iterator[tuple[list[Block], list[int]]]:
    """Labelled pages: parts in random order, with random tags and class words; y marks blocks of the article."""
    rng = random.Random(seed)
    syllables = "the an re tion ing ou be en er ich und ge ver la de que eau os cia ra me nto sch on st lo ma".split()
    count = 0

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def say(lo: int, hi: int, prose: bool = True) -> str:
        nonlocal count
        count += 1
        ws = [word() for _ in range(rng.randint(lo, hi))]
        body = " ".join(w + ("." if prose and rng.random() < 0.1 else "") for w in ws)
        return f"{body} q{count}q" + ("." if prose and rng.random() < 0.9 else "")

    def wrap(kind: list[tuple[str, str]], inner: str) -> str:
        tag, cls = rng.choice(kind)
        return f'<{tag} class="{cls}">{inner}</{tag}>' if cls and rng.random() < 0.8 else f"<{tag}>{inner}</{tag}>" if tag not in ("div", "section", "form") else f'<{tag} id="{cls}">{inner}</{tag}>'

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{say(1, 3, False)}</a></li>' for _ in range(rng.randint(lo, hi))) + "</ul>"

    def prose(lo: int, hi: int) -> str:
        out = []
        for _ in range(rng.randint(lo, hi)):
            p = rng.random()
            body = say(1, 6) if p < 0.15 else say(8, 120)
            if rng.random() < 0.2:
                body = f"<b>{body}</b>"
            if rng.random() < 0.15:
                body += f' <a href="/{word()}">{word()}</a>'
            tag = rng.choices(["p", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption"], [30, 2, 2, 3, 1, 1, 1, 1])[0]
            out.append(f"<ul><li>{body}</li></ul>" if tag == "li" else f"<table><tr><td>{body}</td></tr></table>" if tag == "td" else f"<{tag}>{body}" + ("" if tag == "p" and rng.random() < 0.2 else f"</{tag}>"))
        return "".join(out)

    for _ in range(n):
        bad: dict[str, str] = {
            "nav": wrap([("nav", "menu"), ("nav", ""), ("div", "menu"), ("div", "navbar navigation"), ("ul", "breadcrumbs")], links(2, 8)),
            "header": wrap([("header", ""), ("header", "site header"), ("div", "header masthead")], f"<div>{say(1, 6, False)}</div>" + (links(1, 3) if rng.random() < 0.3 else "") + (f"<p>{say(4, 25)}</p>" if rng.random() < 0.4 else "")),
            "ad": wrap([("div", "ad"), ("div", "ads banner"), ("div", "advert sponsored"), ("section", "promo"), ("div", "advertisement")], f"<p>{say(5, 30)}</p>" if rng.random() < 0.5 else say(4, 25)),
            "aside": wrap([("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("section", "widget")], (f"<h3>{say(1, 4, False)}</h3>" if rng.random() < 0.6 else "") + (links(2, 6) if rng.random() < 0.5 else f"<p>{say(6, 60)}</p>")),
            "notice": wrap([("div", "cookie notice"), ("div", "cookies consent"), ("div", "notice"), ("section", "gdpr banner"), ("div", "alert"), ("div", "popup modal")], f"<p>{say(6, 40)}</p>" + (f"<button>{say(1, 2, False)}</button>" if rng.random() < 0.6 else "")),
            "form": wrap([("form", ""), ("form", "search"), ("form", "newsletter"), ("form", "subscribe")], f"<label>{say(1, 4, False)}</label><input type=text>" + (f"<p>{say(4, 30)}</p>" if rng.random() < 0.5 else "") + f"<button>{say(1, 2, False)}</button>"),
            "footer": wrap([("footer", ""), ("footer", "footer"), ("div", "footer"), ("div", "copyright")], rng.choice(["&copy; ", "", "Copyright 2024 "]) + say(3, 30) + (links(1, 4) if rng.random() < 0.3 else "")),
            "comments": wrap([("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment list"), ("div", "discussion replies")], "".join(f'<div class="comment"><p>{say(5, 60)}</p></div>' if rng.random() < 0.6 else f"<p>{say(5, 60)}</p>" for _ in range(rng.randint(1, 5)))),
            "share": wrap([("div", "share social"), ("div", "tags"), ("div", "byline meta")], say(1, 6, False)),
        }
        inside = [k for k in ("ad", "share", "notice", "form", "aside", "comments") if rng.random() < 0.12]
        body = f"<h1>{say(2, 12, False)}</h1>" if rng.random() < 0.85 else ""
        body += prose(1, 8) if rng.random() < 0.95 else ""
        main_text = body
        for k in inside:
            body += bad[k] + (prose(1, 2) if rng.random() < 0.5 else "")
        main = wrap([("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article body"), ("section", "entry text")], body)
        if rng.random() < 0.3:
            main = wrap([("main", ""), ("div", "page wrapper"), ("div", "container")], main)
        before = [bad[k] for k in ("header", "nav", "ad", "notice", "form", "aside") if k not in inside and rng.random() < 0.55]
        after = [bad[k] for k in ("comments", "share", "aside", "ad", "form", "footer") if k not in inside and bad[k] not in before and rng.random() < 0.55]
        page = f"<html><head><title>{say(1, 8)}</title></head><body>" + "".join(before) + main + "".join(after) + "</body></html>"
        dropped = set(re.findall(r"q\d+q", "".join(bad.values())))
        found = blocks(page)
        y = [int(not set(re.findall(r"q\d+q", b.text)) & dropped) for b in found]
        assert main_text or not any(y) or inside
        yield found, y


_MODEL: dict[tuple, Crf] = {}


def trained(n: int = TRAIN_PAGES, seed: int = SEED) -> Crf:
    """The model fitted on composed pages; fitted once per process."""
    if (n, seed) not in _MODEL:
        _MODEL[n, seed] = fit(list(training_pages(n, seed)))
    return _MODEL[n, seed]


TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])


def main_text(page: str, model: Crf) -> tuple[str, int]:
    """The main blocks' text, and how many blocks the page has."""
    found = blocks(page, model.known)
    return " ".join(b.text for b, y in zip(found, model.decode(found)) if y), len(found)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, url, text (main blocks joined by a space), n_chars (code points), n_blocks.

    A null or empty html has an empty text. Repeated rows are extracted each;
    whole pages are read whatever their length; extra columns are ignored.
    """
    model = model or trained()

    def step(batch: pa.RecordBatch) -> dict:
        done = [main_text(x or "", model) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0).cast(pa.int64()).to_pylist(), "url": batch.column(1).to_pylist(), "text": [t for t, _ in done], "n_chars": [len(t) for t, _ in done], "n_blocks": [n for _, n in done]}

    return arrow_map(pages.select("page_id", "url", "html"), step, TEXTS)
