"""Main text of web pages by boosted trees over DOM nodes.

A page becomes a tree of its block elements. Each node has features of itself
and its place (tag, attribute tokens, depth, siblings, text, links and tags of
its subtree, its ancestors), and gradient-boosted trees give its log-odds of
being main text. Decoding is hierarchical: a node can only be kept if its
parent is, and the kept set with the largest sum of text-weighted log-odds is
found from the leaves up, so ancestors and descendants never contradict.

The trees are trained here, on ``LIMIT`` pages of the table at most. Labels come
from the pages' own article and main elements; each page is also seen with its
landmark elements renamed and with boilerplate blocks put in, which are known
to be none. Extraction runs in tasks over all pages and whole texts.

Text rules: character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one line break.

Edge cases: a null or empty page has an empty text; broken, unclosed and
truncated markup is read as far as it goes; script, style, textarea, title and
iframe reach to their end tag, or to the end of the page without one; the
contents of ``HIDDEN`` elements are left out up to their "/>", their end tag or
the end of the block around them, and the text behind them stays; formulas in
math elements are text; without pages that have a labelled
element the trees learn from the renamed attribute tokens alone or, if there is
nothing to learn from, all blocks outside landmark elements are kept; extra
columns are dropped; repeated rows give the same text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, SEED = 300, 5
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 40, 4, 32, 0.3, 20

# fixed values: element names
BLOCKS = set("""address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe"
HIDDEN = set("annotation annotation-xml audio canvas noscript object select svg template video".split())
GROUPS = [["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6"], ["li", "dd", "dt"], ["ul", "ol", "dl", "menu"], ["div"],
          ["section"], ["article"], ["main"], ["aside"], ["nav"], ["header"], ["footer"],
          ["table", "tbody", "thead", "tr", "td", "th"], ["form", "fieldset"], ["blockquote", "pre"],
          ["figure", "figcaption"], ["body", "html"]]
# fixed values: tokens of class, id and role attributes
TOKENS = {
    "main": "article body content entry main post prose story text",
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation pagination pager tabs toc",
    "frame": "bottom copyright foot footer head header masthead site topbar",
    "side": "aside more popular recommended related rail side sidebar trending widget",
    "advert": "ad adbox ads advert advertisement banner promo promoted promotion sponsor sponsored",
    "notice": "alert banner consent cookie cookies gdpr modal notice overlay popup warning",
    "comment": "comment comments discussion disqus replies reply respond thread",
    "action": "form login newsletter search share sharing signup social subscribe tools",
}
_TOKEN_GROUP = {t: k for k, words in enumerate(TOKENS.values()) for t in words.split()}
_TAG_GROUP = {t: k for k, tags in enumerate(GROUPS) for t in tags}
_LANDMARK_OFF = {"aside", "nav", "header", "footer", "form"}

_PIECE = re.compile(rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})(?=[\s/>])(?P<rest>[^>]*)>|<[!?][^>]*>|"
                    r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*$",
                    re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in RAW.split("|")}
INLINE, INSIDE, CLOSED, OPEN = -1, -2, -3, -4  # stack marks: inline, a block in a hidden element, hidden with and without an end tag
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
ON, OFF = "data-learn-on", "data-learn-off"  # marks of training pages


@dataclass
class Page:
    """Block elements in page order (node 0 is the page) and their texts."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    segments: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


def _pieces(source: str) -> list[tuple[int, int, str, str, bool]]:
    """``start, end, tag, attributes, is an end tag`` of all markup; a raw
    element is one piece, and what is no element has an empty tag."""
    out, at, foreign = [], 0, 0
    while m := _PIECE.search(source, at):
        at = m.end()
        if m["raw"]:
            tag = m["raw"].lower()
            if not (foreign > 0 and m["rest"].endswith("/")):  # svg has self-closing ones
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
            out.append((m.start(), at, tag, "", False))
        elif m["tag"]:
            tag, attrs = m["tag"].lower(), m["attrs"]
            if tag in HIDDEN and attrs and attrs[0] not in " \t\n\r\f/":
                tag += "-"  # a longer name with signs that the pattern does not know
            if tag in ("svg", "math") and not attrs.endswith("/"):
                foreign += -1 if m["end"] else 1
            out.append((m.start(), at, tag, attrs, bool(m["end"])))
        else:
            out.append((m.start(), at, "", "", False))
    return out


def _closed(pieces: list[tuple[int, int, str, str, bool]]) -> set[int]:
    """Hidden elements that have an end tag of their own, by their piece."""
    waiting, found = {}, set()
    for k, (_, _, tag, attrs, end) in enumerate(pieces):
        if tag in HIDDEN:
            if not end and not attrs.endswith("/"):
                waiting.setdefault(tag, []).append(k)
            elif end and waiting.get(tag):
                found.add(waiting[tag].pop())
    return found


def parse(source: str | None) -> Page:
    page, stack, at, links, held, linked, hidden = Page(), [("html", 0)], 0, 0, [], 0, 0
    source = source or ""
    pieces = _pieces(source)
    closed = _closed(pieces)

    def text(chunk: str) -> None:
        nonlocal linked
        if chunk and not hidden:
            held.append(chunk)
            linked += len(chunk) if links else 0

    def flush() -> None:
        nonlocal linked
        if held:
            joined = "".join(held)
            clean = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if clean:
                node = next(n for _, n in reversed(stack) if n >= 0)
                page.segments.append((node, clean, linked))
            held.clear()
            linked = 0

    def cut(depth: int) -> None:
        nonlocal links, hidden
        links -= sum(t == "a" for t, _ in stack[depth:])
        hidden -= sum(n <= CLOSED for _, n in stack[depth:])
        del stack[depth:]

    def implied_end(tag: str) -> int:
        """Place of the element that the start of block ``tag`` ends, or 0."""
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            name, n = stack[k]
            if n in (INSIDE, CLOSED):
                return 0
            if name == "p" or name in closes or (tag == "body" and n == OPEN):
                return k
            if n >= 0:
                return 0
        return 0

    for k, (start, end, tag, attrs, is_end) in enumerate(pieces):
        text(source[at:start])
        at = end
        if tag in _RAW_END:
            if tag == "title" and not hidden:
                flush()
        elif not tag:
            continue
        elif is_end:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                if any(n >= 0 for _, n in stack[depth:]):
                    flush()
                cut(depth)
        elif tag in VOID:
            if tag == "hr" and not hidden:
                flush()
            else:
                text(" ")
        elif tag in BLOCKS:
            depth = implied_end(tag)
            if hidden and not depth:
                if not attrs.endswith("/"):
                    stack.append((tag, INSIDE))
                continue
            flush()
            if depth:
                cut(depth)
            page.tag.append(tag)
            page.attrs.append(attrs)
            page.parent.append(next(n for _, n in reversed(stack) if n >= 0))
            if not attrs.endswith("/"):
                stack.append((tag, len(page.tag) - 1))
        elif tag in HIDDEN:
            if not attrs.endswith("/"):
                stack.append((tag, CLOSED if k in closed else OPEN))
                hidden += 1
        else:
            if tag == "a":
                links += 1
            stack.append((tag, INLINE))
    text(source[at:])
    flush()
    return page


def attribute_groups(attrs: str) -> set[int]:
    found = set()
    for m in _ATTR.finditer(attrs):
        for token in _CAMEL.split(m[2] or m[3] or m[4] or ""):
            if (k := _TOKEN_GROUP.get(token.lower())) is not None:
                found.add(k)
    return found


N_TAG, N_TOK = len(GROUPS), len(TOKENS)
FEATURES = N_TAG + 3 * N_TOK + 22


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    x = np.zeros((n, FEATURES))
    own, link, words, marks = (np.zeros(n) for _ in range(4))
    for node, t, k in page.segments:
        own[node] += len(t)
        link[node] += min(k, len(t))
        words[node] += t.count(" ") + 1
        marks[node] += t.count(".") + t.count(",")
    parent = np.array(page.parent)
    sub, sublink, nodes, items = own.copy(), link.copy(), np.ones(n), np.zeros(n)
    depth, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
    off, on = np.zeros(n), np.zeros(n)
    for i in range(n):
        tag, p = page.tag[i], page.parent[i]
        if (g := _TAG_GROUP.get(tag)) is not None:
            x[i, g] = 1
        if page.attrs[i]:
            for k in attribute_groups(page.attrs[i]):
                x[i, N_TAG + k] = 1
        items[i] = tag == "li"
        if p >= 0:
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            off[i] = off[p] or page.tag[p] in _LANDMARK_OFF
            on[i] = on[p] or page.tag[p] in ("article", "main")
            x[i, N_TAG + N_TOK:N_TAG + 2 * N_TOK] = np.maximum(x[p, N_TAG + N_TOK:N_TAG + 2 * N_TOK], x[p, N_TAG:N_TAG + N_TOK])
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        sub[p] += sub[i]
        sublink[p] += sublink[i]
        nodes[p] += nodes[i]
        items[p] += items[i]
        x[p, N_TAG + 2 * N_TOK:N_TAG + 3 * N_TOK] = np.maximum(x[p, N_TAG + 2 * N_TOK:N_TAG + 3 * N_TOK], np.maximum(
            x[i, N_TAG + 2 * N_TOK:N_TAG + 3 * N_TOK], x[i, N_TAG:N_TAG + N_TOK]))
    siblings = np.where(parent >= 0, children[parent], 1)
    total, before = max(own.sum(), 1), np.cumsum(own) - own
    up = lambda a: np.where(parent >= 0, a[parent], 0)
    extra = (np.log1p(own), np.log1p(sub), link / np.maximum(own, 1), sublink / np.maximum(sub, 1),
             nodes / np.maximum(sub, 1) * 100, items / nodes, children, depth, place, siblings, place / np.maximum(siblings, 1),
             own / np.maximum(words, 1), marks / np.maximum(words, 1), before / total, sub / total, off, on,
             np.log1p(up(own)), np.log1p(up(sub)), sub / np.maximum(up(sub), 1), up(sublink) / np.maximum(up(sub), 1), up(items) / np.maximum(up(nodes), 1))
    x[:, N_TAG + 3 * N_TOK:] = np.stack(extra, axis=1)
    return x


@dataclass
class Trees:
    """Gradient-boosted trees of fixed depth: node k has children 2k + 1, 2k + 2."""

    base: float = 0.0
    column: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, limit, leaf in zip(self.column, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, column[at]] > limit[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic loss, second-order gains over quantile bins."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    f, width = np.full(len(y), model.base), x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h, at = y - p, np.maximum(p * (1 - p), 1e-6), np.zeros(len(y), dtype=np.int64)
        column, limit = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                best, cut = 1e-3, 0
                if len(own) >= 2 * LEAST_LEAF:
                    flat = (bins[own] + np.arange(width) * BINS).ravel()
                    sums = [np.bincount(flat, weights=np.repeat(w, width), minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                            for w in (g[own], h[own], np.ones(len(own)))]
                    (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                    c, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[c, b] > best and b < len(cuts[c]):
                        column[node], limit[node], cut = c, cuts[c][b], b
                if np.isfinite(limit[node]):
                    at[own] = 2 * node + 1 + (bins[own, column[node]] > cut)
                else:
                    at[own] = 2 * node + 1
        leaf_at = at - (2**DEPTH - 1)
        sums = [np.bincount(leaf_at, weights=w, minlength=2**DEPTH) for w in (g, h)]
        leaf = RATE * sums[0] / (sums[1] + 1)
        f += leaf[leaf_at]
        model.column.append(column)
        model.limit.append(limit)
        model.leaf.append(leaf)
    return model


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Nodes kept: a child only with its parent, by the largest sum."""
    n = len(page.tag)
    own = np.zeros(n)
    for node, text, _ in page.segments:
        own[node] += len(text)
    gain = np.clip(odds, -8, 8) * np.sqrt(own)
    for i in range(n - 1, 0, -1):
        gain[page.parent[i]] += max(gain[i], 0.0)
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and gain[i] > 0
    return kept & (odds > 0)


def main_text(page: Page, kept: np.ndarray) -> str:
    return "\n".join(t for node, t, _ in page.segments if kept[node])


def node_labels(page: Page) -> np.ndarray:
    """1 for nodes in a marked, article or main element and in no landmark or
    marked block of other kind inside it."""
    n = len(page.tag)
    marked = any(ON in a for a in page.attrs)
    y = np.zeros(n)
    for i in range(1, n):
        inside = y[page.parent[i]] or (ON in page.attrs[i] if marked else page.tag[i] in ("article", "main"))
        y[i] = inside and OFF not in page.attrs[i] and page.tag[i] not in _LANDMARK_OFF
    return y


_INSERTS = [
    '<aside class="{side}" {off}><h3>{a}</h3><ul><li><a href="#">{b}</a></li><li><a href="#">{c}</a></li></ul></aside>',
    '<div class="{side}" {off}><p>{a}</p><p>{b}</p></div>',
    '<div id="{comment}" {off}><h3>{a}</h3><div class="{comment}"><p>{b}</p></div><div class="{comment}"><p>{c}</p></div></div>',
    '<section class="{comment}" {off}><p>{b}</p><p>{c}</p></section>',
    '<div class="{notice}" {off}><p>{a}</p></div>', '<div class="{advert}" {off}>{b}</div>',
    '<form class="{action}" {off}><label>{a}</label><p>{b}</p></form>', '<div class="{action}" {off}><a href="#">{a}</a> <a href="#">{b}</a></div>',
    '<header class="{frame}" {off}><h2>{a}</h2><p>{b}</p></header>', '<div class="{menu}" {off}><a href="#">{a}</a><a href="#">{b}</a></div>',
]


def variants(source: str, seed: int) -> list[str]:
    """The page itself and two changed copies, for training."""
    rng, out = random.Random(seed), [source]
    words = re.sub(r"<[^>]*>", " ", source).split() or ["text"]
    token = lambda k: rng.choice(TOKENS[k].split())
    some = lambda: " ".join(words[(i := rng.randrange(len(words))):i + rng.choice([2, 5, 12, 30])])
    block = lambda: rng.choice(_INSERTS).format(off=OFF, a=some(), b=some(), c=some(), **{k: token(k) for k in TOKENS})
    for renamed in (False, True):
        page = re.sub(r"<(article|main)\b", rf"<\1 {ON}", source, count=1)
        for place in rng.sample([r"<(?:article|main)\b", r"</(?:article|main)>", r"</p>(?=<p>)", r"<footer\b", r"</nav>"], 4):
            if found := list(re.finditer(place, page)):
                m = rng.choice(found)
                at = m.end() if place.startswith("</") else m.start()
                page = page[:at] + block() + page[at:]
        if renamed:
            style = rng.choice(["", f' class="{token("main")}"', f' id="{token("main")}"'])
            page = re.sub(r"<(article|main)\b", f"<div{style}", page)
            page = re.sub(r"</(article|main)>", "</div>", page)
            page = re.sub(r"<nav\b", f'<div class="{token("menu")}"', page).replace("</nav>", "</div>")
            page = re.sub(r"<footer\b", f'<div class="{token("frame")}"', page).replace("</footer>", "</div>")
        out.append(page)
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = LIMIT, seed: int = SEED) -> Trees:
    """Trains on ``limit`` different pages at most, chosen by the hash of their
    source; copies of a page count once and empty pages not at all."""
    own = pages.select(F.col(html_col).cast("string").alias("html")).filter("html != ''").withColumn("h", F.xxhash64(F.lit(seed), "html"))
    first = own.select("h").distinct().orderBy("h").limit(limit)  # hashes alone are dealt out; the limit bounds the broadcast
    sample = own.join(F.broadcast(first), "h").groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(limit).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, source in enumerate(batch.column(0).to_pylist()):
                for v in variants(source, seed * 1000 + k):
                    page = parse(v)
                    yield pa.record_batch({"x": pa.array([features(page).astype(np.float32).tobytes()]),
                                           "y": pa.array([node_labels(page).astype(np.float32).tobytes()])})

    rows = sorted((bytes(r["x"]), bytes(r["y"])) for r in sample.mapInArrow(run, "x binary, y binary").collect())
    if not rows:
        return Trees()
    x = np.concatenate([np.frombuffer(r, np.float32).reshape(-1, FEATURES) for r, _ in rows]).astype(np.float64)
    return boost(x, np.concatenate([np.frombuffer(r, np.float32) for _, r in rows]).astype(np.float64))


def extract(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page."""
    given = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                parsed = [parse(s) for s in part.column(2).to_pylist()]
                x = [features(p) for p in parsed]
                odds = np.split(given.value.log_odds(np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1])
                if not given.value.leaf:
                    odds = [np.where(v[:, FEATURES - 7] > 0, -1.0, 1.0) for v in x]
                texts = [main_text(p, decode(p, o)) for p, o in zip(parsed, odds, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
