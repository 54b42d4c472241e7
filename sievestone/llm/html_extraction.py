"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its runs of inline text as leaves. Each node has a hidden state, content or
not; a node's tag, attribute words and text shape give its unary potential, a parent and a child have a pairwise
potential by the kind of the child. Sum-product messages pass up and then down the tree and yield each leaf's marginal.
Unary weights and pairwise potentials are learned by gradient ascent on the likelihood of labelled pages.

The tables hold no labelled pages, so training_pages() writes some from templates, with invented words, and labels each
node. No feature looks at words of the text, so pages of any language are treated alike.

Defined results: a null page is an empty page; a page without content has the empty text. Unclosed and stray tags are
mended as browsers mend them. Repeated rows are each extracted. Texts are read whole. Added columns replace columns of
the same name.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.session import arrow_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|svg|select|object|math)\b(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element closes when it opens, up to the element that holds it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select menu body html".split())
TAGS = "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset button table tbody tr td th blockquote pre figure figcaption details address hr".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar tabs skip sitemap",
    "header": "header masthead logo branding top hero",
    "footer": "footer bottom copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget related recommended trending popular complementary archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert banner newsletter subscribe subscription popup modal overlay toast paywall message disclaimer",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promoted promotion dfp outbrain taboola",
    "form": "form search login signup signin register contact poll survey",
    "comment": "comment comments reply replies respond disqus discussion reader readers guestbook feedback reviews",
    "share": "share sharing social facebook twitter follow like print",
    "content": "content article post entry story text main body articlebody page prose",
}
GROUP_OF = {w: i for i, ws in enumerate(GROUPS.values()) for w in ws.split()}
N_GROUPS = len(GROUPS)
#: Kinds of children, each with a table of pairwise potentials.
ELEMENT, MARKED, LEAF, PARAGRAPH, HEADING, ITEM = range(6)
KINDS = 6
KIND_OF = {"p": PARAGRAPH, "pre": PARAGRAPH, "blockquote": PARAGRAPH, **{f"h{i}": HEADING for i in range(1, 7)}, **dict.fromkeys("ul ol li dl dt dd table tbody tr td th".split(), ITEM)}
SEMANTIC = frozenset("nav header footer aside form fieldset button head article main details address".split())
# features: tags, other tag, attribute groups, leaf shape (length, share of links, end of sentence), tag of the leaf's parent;
# of an element, by its tag's place in SHAPED: length and share of links of all text below
AT_GROUP = len(TAGS) + 1
AT_LENGTH = AT_GROUP + N_GROUPS
AT_LINKS = AT_LENGTH + 8
AT_END = AT_LINKS + 3
AT_PARENT = AT_END + 2
AT_BELOW = AT_PARENT + len(TAGS) + 1
SHAPED = {"article": 0, "main": 0, "section": 1, "div": 1, "td": 1, "aside": 2, "ul": 2, "ol": 2, "table": 2}
SHAPED_AT = {TAG_AT[t]: AT_BELOW + 9 * k for t, k in SHAPED.items()}
N_FEATURES = AT_BELOW + 3 * (6 + 3)


@dataclass
class Model:
    unary: list[float]
    pair: list[list[float]]  # by kind of child: the potentials of (parent, child) = 00, 01, 10, 11


def parse(page: str) -> tuple[list[int], list[int], list[list[int]], list[str | None]]:
    """(parent, kind, features, text) of each node, parents first; text of leaves only, white space made single."""
    parent, kind, feats, text = [-1], [ELEMENT], [[]], [None]
    stack: list[tuple[int, str]] = [(0, "")]
    open_tags: Counter[str] = Counter()  # of the stack: a stray closing tag need not search it
    parts: list[str] = []
    in_link, linked = 0, 0
    tag_of = [len(TAGS)]

    def close(k: int) -> None:
        """The stack down to its first k elements."""
        for _, t in stack[k:]:
            open_tags[t] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if parts:
            run = " ".join("".join(parts).split())
            if run:
                up = stack[-1][0]
                n = len(run)
                share = linked / n
                parent.append(up)
                kind.append(LEAF)
                feats.append(
                    [AT_LENGTH + min(7, n.bit_length() - 1), AT_LINKS + (0 if share < 0.2 else 1 if share < 0.7 else 2), AT_END + (run[-1] in ".!?…:;\"'”»)"), AT_PARENT + tag_of[up]]
                )
                text.append(run)
                tag_of.append(0)
            parts.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            if "&" in raw:
                raw = html.unescape(raw)
            parts.append(raw)
            if in_link:
                linked += len(raw)
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        closing, attributes = m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k][1] == tag:
                    close(k)
                    in_link = 0
                    break
                if tag in ("p", "li") and stack[k][1] in HOLDS:
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1][1] == "p":
            close(len(stack) - 1)
        ends = CLOSES.get(tag)
        if ends and any(open_tags[t] for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in ends:
                    close(k)
                    break
                if stack[k][1] in HOLDS and stack[k][1] not in ends:
                    break
        number = TAG_AT.get(tag, len(TAGS))
        own = [number]
        if attributes:
            for value in ATTRIBUTES.findall(attributes):
                for word in WORD.findall(value.lower()):
                    group = GROUP_OF.get(word)
                    if group is not None and AT_GROUP + group not in own:
                        own.append(AT_GROUP + group)
        parent.append(stack[-1][0])
        kind.append(MARKED if len(own) > 1 or tag in SEMANTIC else KIND_OF.get(tag, ELEMENT))
        feats.append(own)
        text.append(None)
        tag_of.append(number)
        stack.append((len(parent) - 1, tag))
        open_tags[tag] += 1
    if at < len(page):
        raw = html.unescape(page[at:])
        parts.append(raw)
        if in_link:
            linked += len(raw)
    flush()
    below, links = [0] * len(parent), [0] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        fs = feats[i]
        if text[i] is not None:
            below[i] = len(text[i])
            links[i] = below[i] * (fs[1] - AT_LINKS)
        else:
            shaped = SHAPED_AT.get(fs[0])
            if shaped is not None:
                share = links[i] / (2 * below[i] or 1)
                fs.append(shaped + min(5, below[i].bit_length() // 2))
                fs.append(shaped + 6 + (0 if share < 0.2 else 1 if share < 0.7 else 2))
        below[parent[i]] += below[i]
        links[parent[i]] += links[i]
    return parent, kind, feats, text


def _ratio(a: float, b: float, c: float, d: float, x: float) -> float:
    """log of (e^c + e^(d+x)) / (e^a + e^(b+x)) without overflow."""
    if x > 30:
        return d - b + (math.exp(c - d - x) - math.exp(a - b - x))
    e = math.exp(x) if x > -700 else 0.0
    return math.log((math.exp(c) + math.exp(d) * e) / (math.exp(a) + math.exp(b) * e))


def marginals(parent: list[int], kind: list[int], feats: list[list[int]], model: Model) -> tuple[list[float], list[float], list[float]]:
    """(belief, from below, cavity of the parent) of each node as log odds: sum-product up, then down."""
    n, unary, pair = len(parent), model.unary, model.pair
    up = [sum([unary[f] for f in fs]) for fs in feats]
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        t = pair[kind[i]]
        sent[i] = m = _ratio(t[0], t[1], t[2], t[3], up[i])
        up[parent[i]] += m
    belief, cavity = up[:], [0.0] * n
    for i in range(1, n):
        t = pair[kind[i]]
        cavity[i] = v = belief[parent[i]] - sent[i]
        belief[i] += _ratio(t[0], t[2], t[1], t[3], v)
    return belief, up, cavity


def extract(page: str | None, model: Model) -> str:
    parent, kind, feats, text = parse(page or "")
    if len(parent) == 1:
        return ""
    belief, _, _ = marginals(parent, kind, feats, model)
    return "\n\n".join([t for t, b in zip(text, belief, strict=True) if t is not None and b > 0])


def fit_pages(pages: list[str], epochs: int = 12, rate: float = 0.3, seed: int = 5) -> Model:
    """Adaptive gradient ascent on the likelihood of pages whose leaves say what they are (see training_pages)."""
    data = []
    for page in pages:
        parent, kind, feats, text = parse(page)
        # a leaf is content if its text says so; an element, if it holds a leaf, paragraph, heading or item that is
        state = [int(t is not None and t.startswith("+")) for t in text]
        for i in range(len(parent) - 1, 0, -1):
            if state[i] and kind[i] not in (MARKED, ELEMENT):
                state[parent[i]] = 1
        data.append((parent, kind, feats, state))
    model = Model([0.0] * N_FEATURES, [[0.5, -0.5, -0.5, 0.5] for _ in range(KINDS)])
    seen_u, seen_p = [1e-3] * N_FEATURES, [[1e-3] * 4 for _ in range(KINDS)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for parent, kind, feats, state in data:
            belief, up, cavity = marginals(parent, kind, feats, model)
            step_u: dict[int, float] = {}
            step_p = [[0.0] * 4 for _ in range(KINDS)]
            for i in range(1, len(parent)):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, belief[i]))))
                for f in feats[i]:
                    step_u[f] = step_u.get(f, 0.0) + state[i] - p
                t, v, u = model.pair[kind[i]], cavity[i], up[i]
                z = [t[0], t[1] + u, t[2] + v, t[3] + u + v]
                top = max(z)
                w = [math.exp(x - top) for x in z]
                total = sum(w)
                g = step_p[kind[i]]
                for k in range(4):
                    g[k] -= w[k] / total
                g[2 * state[parent[i]] + state[i]] += 1
            for f, g in step_u.items():
                g -= 0.002 * model.unary[f]
                seen_u[f] += g * g
                model.unary[f] += rate * g / math.sqrt(seen_u[f])
            for k in range(KINDS):
                for j in range(4):
                    g = step_p[k][j] - 0.002 * model.pair[k][j]
                    seen_p[k][j] += g * g
                    model.pair[k][j] += rate * g / math.sqrt(seen_p[k][j])
    return model


def training_pages(n: int, seed: int = 3) -> list[str]:
    """Labelled pages: each text begins with + if it is content, with - if not."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(("ba", "ke", "lo", "mi", "tu", "ra", "sen", "dor")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(sign: str, a: int, b: int) -> str:
        return sign + words(a, b) + pick((".", ".", ".", "!", "?", ""))

    def links(k: int, sign: str = "-") -> str:
        style = pick(("li", "li", "a", "p"))
        items = [f'<a href="/x">{sign}{words(1, 3)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style == "li" else "".join(f"<{style}>{x}</{style}>" for x in items) if style == "p" else " | ".join(items)

    def box(tag: str, names: list[str], inner: str) -> str:
        name = pick(names)
        attribute = "" if not name else f' {pick(("class", "id", "class", "role"))}="{name}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def boilerplate() -> str:
        what = rng.randrange(11)
        if what == 0:
            return box("nav", ["", "", "menu", "main-menu"], links(rng.randint(2, 8)))
        if what == 1:
            return box("div", ["nav", "menu", "breadcrumb", "navbar top", "pagination"], links(rng.randint(2, 6)))
        if what == 2:
            return box("header", ["", "site-header", "masthead"], pick((f"<h1>-{words(1, 4)}</h1>", f"<p>-{words(2, 6)}</p>", f"<div>-{words(1, 4)}</div>")) + pick(("", links(3))))
        if what == 3:
            return box(pick(("footer", "footer", "div")), ["footer", "site-footer", "page-footer"] , pick(("", "<p>")) + f"-&copy; {words(1, 3)} &middot; {words(3, 25)}.")
        if what == 4:
            return box("aside", ["", "sidebar", "related"], f"<h3>-{words(1, 3)}</h3>" + pick((links(4), f"<p>{sentence('-', 5, 40)}</p>")))
        if what == 5:
            return box("div", ["sidebar", "widget", "related-posts", "side"], f"<h2>-{words(1, 3)}</h2>" + pick((links(4), f"<p>{sentence('-', 5, 40)}</p><p>{sentence('-', 5, 40)}</p>")))
        if what == 6:
            return box("div", ["cookie-notice", "cookie-banner", "notice", "alert", "newsletter", "consent popup"], pick((f"<p>{sentence('-', 5, 40)}</p>", sentence("-", 5, 40))) + pick(("", f"<button>-{words(1, 2)}</button>")))
        if what == 7:
            return box(pick(("div", "section", "div")), ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"], pick((sentence("-", 3, 40), f"<p>{sentence('-', 5, 40)}</p>")))
        if what == 8:
            return box("form", ["", "search", "login"], f"<label>-{words(1, 3)}</label><input name=q><button>-{words(1, 2)}</button>" + pick(("", f"<p>{sentence('-', 4, 30)}</p>")))
        if what == 9:
            kind = pick(("li", "li", "div", "div", "div", "p", "p", "article"))
            inner = "".join(f'<{kind}{" class=comment" if kind == "article" else pick(("", " class=comment"))}>' + pick(("", f"<h4>-{words(1, 2)}</h4>")) + f"<p>{sentence('-', 4, 60)}</p></{kind}>" for _ in range(rng.randint(1, 4)))
            return box(pick(("section", "div", "div", "ul" if kind == "li" else "div")), ["comments", "comment-list", "discussion", "reader-comments", "replies"], f"<h3>-{words(1, 3)}</h3>" * rng.randint(0, 1) + inner)
        return box("div", ["share", "social", "share-buttons", "tags"], links(3))

    def content() -> str:
        what = rng.randrange(14)
        if what == 0:
            return f"<h2>+{words(1, 8)}</h2>"
        if what == 1:
            return f"<ul>{''.join(f'<li>{sentence("+", 1, 20)}</li>' for _ in range(rng.randint(1, 5)))}</ul>"
        if what == 2:
            return f"<blockquote>{pick(('', '<p>'))}{sentence('+', 3, 40)}</blockquote>"
        if what == 3:
            return f"<table><tr>{''.join(f'<td>+{words(1, 4)}</td>' for _ in range(3))}</tr></table>"
        if what == 4:
            return f"<pre>+{words(3, 30)}</pre>"
        if what == 5:
            return f"<div>{sentence('+', 5, 60)}</div>"
        if what == 6:
            return f"<p><b>{sentence('+', 1, 90)}<br>"
        if what == 7:
            return f"<p>+{words(1, 3)} <a href=/y>{words(1, 4)}</a> {words(1, 30)}.</p>"
        if what == 8:
            return f"<figure><img src=x><figcaption>+{words(3, 12)}</figcaption></figure>"
        if what == 9:
            return f"<section>{''.join(f'<p>{sentence("+", 3, 60)}</p>' for _ in range(rng.randint(1, 3)))}</section>"
        return f"<p>{sentence('+', 1, 90)}</p>"

    pages = []
    for _ in range(n):
        body = pick((f"<h1>+{words(2, 10)}</h1>", f"<header><h1>+{words(2, 10)}</h1></header>" if rng.random() < 0.2 else "", f"<h1>+{words(2, 10)}</h1>"))
        for _ in range(rng.randint(1, 10)):
            body += content()
            if rng.random() < 0.06:
                body += boilerplate()
        wrapper = rng.randrange(9)
        if wrapper < 4:
            body = box("article", ["", "", "post", "story"], body)
        elif wrapper == 4:
            body = box("main", ["", "content"], body)
        elif wrapper == 5:
            body = box("div", ["content", "post-body", "entry-content", "article-body", "main", "story text"], body)
        elif wrapper == 6:
            body = f"<div>{body}</div>"
        elif wrapper == 7:
            body = f"<main><article>{body}</article></main>"
        before = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
        after = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
        inner = before + body + after
        if rng.random() < 0.25:
            inner = f'<div class="{pick(("page", "wrapper", "container", "layout"))}">{inner}</div>'
        pages.append(f"<html><head><title>-x</title></head><body>{inner}</body></html>")
    return pages


def fit(n_pages: int = 500) -> Model:
    return fit_pages(training_pages(n_pages))


def extract_pages(pages: DataFrame, model: Model, page: str = "html") -> DataFrame:
    """pages, without the html, with text and n_chars; one pass in Arrow batches, no shuffle."""
    added = ("text", "n_chars")
    rest = [c for c in pages.columns if c not in added and c != page]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                texts = [extract(p, model) for p in some.column(page).to_pylist()]
                n = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(n)], [*rest, *added])

    arrow_batches(pages.sparkSession)
    return pages.select(*[F.col(f"`{c}`") for c in [*rest, page]]).mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages.select("page_id", "url", "html"), fit())
