"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text. A logistic model's log-odds become the capacities of edges to two
terminals, neighbouring blocks and blocks close to each other in the document tree are joined by
smoothness edges, and a minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.llm.util import hash_sample

#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "canvas", "math", "textarea", "select", "button", "option", "datalist", "audio", "video"}
#: Of those, the ones whose content is not markup.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "big"}
#: Elements that a new one of them closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Block elements before which an open paragraph ends.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that may stand in a head; any other ends it.
IN_HEAD = {"head", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
#: Elements that hold content, and ones that hold what is around it.
GOOD = {"article", "main"}
BAD = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"}
#: Words of class, id and role. Reader comments; what is never content; what is not unless a word of content stands with it; content.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}
NEVER = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "promoted", "sponsor", "sponsored", "sponsors", "sidebar", "widget", "widgets",
         "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe",
         "signup", "login", "pagination", "pager", "toolbar", "complementary", "contentinfo"}
SELDOM = {"header", "head", "foot", "side", "notice", "notices", "overlay", "share", "sharing", "social", "related", "recommended", "recommendations", "tag", "tags", "search", "skip", "legal",
          "copyright", "alert"}
CONTENT = {"article", "content", "entry", "post", "story", "main", "text", "body", "page", "news", "blog"}
#: First words of names that tell a state of the page, not what an element is.
STATES = {"has", "no", "with", "without", "is", "js", "wp", "single"}
#: What names say of a block, as log-odds: reader comments, elements and words of what is never content, seldom content,
#: nothing, words of content, an element of content. All are less than what text and place may say.
SAYS = {"comments": -4.5, "never": -4.0, "named": -4.0, "seldom": -4.0, "": 0.0, "words": 1.0, "element": 4.0}
#: The most that text and place say of a block, either way.
MOST = 5.0
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The end of a tag, or the quote that begins an attribute's value.
STOP = re.compile(r">|=\s*([\"'])")
ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: An attribute's name and, if it has one, its value: quoted either way or bare.
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
#: What a tag has to hold for its attributes to be read for being hidden.
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass(slots=True)
class Block:
    """White space is single blanks. ``depth``: open block elements; ``low``: the fewest since the block
    before; ``parent``: number of what holds the block's own element; ``says``: a key of ``SAYS``."""

    text: str
    depth: int
    low: int
    parent: int
    tag: str
    says: str
    linked: int


def said(tag: str, attrs: str, before: str) -> str:
    """What an element's names say of the blocks in it, a key of ``SAYS``, given what those around it say.

    Comments stay comments whatever is in them, and what an element makes never content stays that; only an element of
    content leads out of what is seldom content. One within what only a name calls never content is content if the page
    has no other. Names are cut into words, so that one word does not decide
    for a compound: a word of content balances a seldom one. Page-wide elements' names tell of the page.
    """
    if before == "comments":
        return before
    words: set[str] = set()
    if "=" in attrs and tag not in ("html", "body"):
        for _, a, b, c in ATTR.findall(attrs):
            for name in (a or b or c).split():
                parts = [w.lower() for w in PARTS.findall(name)]
                if tag in GOOD:
                    words |= COMMENTS.intersection(parts[:1])
                elif parts and parts[0] not in STATES:
                    words.update(parts)
    if words & COMMENTS:
        return "comments"
    if before == "never":
        return before
    if tag in GOOD:
        return "inner" if before in ("named", "inner") else "element"
    if before in ("named", "inner") and tag not in BAD:
        return before
    if tag in BAD and not (tag == "header" and before == "element"):
        # A form may be around a whole page: content elements lead out of it.
        return "named" if tag == "form" else "never"
    if words & NEVER:
        return "named"
    if before == "element":
        words -= {"header", "head"}
    if words & SELDOM and not words & CONTENT and tag not in HEADINGS:
        return "seldom"
    return "words" if before == "" and words & CONTENT else before


def hidden(attrs: str) -> bool:
    """Whether a tag's attributes hide its element: ``hidden``, ``aria-hidden`` of true, or a style without display."""
    if not MAY_HIDE.search(attrs):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and (a or b or c).strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(a or b or c)):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, in one pass whose time is in proportion to the page.

    Elements left open end with what holds them. A tag that the page's end cuts off is no text. Once a
    quoted value has no end, later tags end at their first ``>``.
    """
    out: list[Block] = []
    stack: list[tuple] = []  # name, is a block, what was before: (says, silent, in a link)
    inner: list[tuple[str, int]] = [("", 0)]  # block elements: name and number
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    says, silent, link = "", 0, 0
    number = linked = low = 0
    quotes = True

    def flush() -> None:
        nonlocal linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                depth = len(inner) - 1
                out.append(Block(text, depth, min(low, depth), inner[-2][1] if depth else 0, inner[-1][0], says, min(linked, len(text))))
                low = depth
            parts.clear()
        linked = 0

    def text_at(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            got = unescape(raw) if "&" in raw else raw
            parts.append(got)
            if link:
                linked += len(got.strip())

    def close(names: set[str] | frozenset[str]) -> None:
        """End elements up to one of these, which is open."""
        nonlocal says, silent, link, low
        while stack:
            name, block, before = stack.pop()
            n_open[name] -= 1
            says, silent, link = before
            if block:
                inner.pop()
                low = min(low, len(inner) - 1)
            if name in names:
                return

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            break
        mark = html[lt + 1 : lt + 2]
        closing = mark == "/"
        m = NAME.match(html, lt + 1 + closing)
        if mark == "!" or mark == "?" or (closing and m is None):
            text_at(html[at:lt])
            stop = html.find("-->", lt + 2) + 2 if html.startswith("<!--", lt) else html.find(">", lt)
            at = end if stop < lt + 2 else stop + 1
            continue
        if m is None:
            text_at(html[at : lt + 1])
            at = lt + 1
            continue
        text_at(html[at:lt])
        stop = -1
        if quotes:
            k = m.end()
            while (q := STOP.search(html, k)) is not None:
                if q[1] is None:
                    stop = q.start()
                    break
                k = html.find(q[1], q.end()) + 1
                if k == 0:
                    break
            quotes = stop >= 0
        if stop < 0:
            stop = html.find(">", m.end())
        if stop < 0:
            at = end
            break
        name, attrs, at = m[0].lower(), html[m.end() : stop], stop + 1
        block = name not in INLINE
        if block:
            flush()
        if closing:
            if n_open[name]:
                close({name})
            continue
        if name in VOID:
            continue
        if n_open["head"] and name not in IN_HEAD:
            close({"head"})
        if name in ENDS_P and n_open["p"]:
            close({"p"})
        elif name in CLOSES:
            # The one that this ends is the innermost block but for a paragraph, whatever inline elements were left open in it.
            for other, _ in reversed(inner):
                if other in CLOSES[name]:
                    close(CLOSES[name])
                if other != "p":
                    break
        stack.append((name, block, (says, silent, link)))
        n_open[name] += 1
        if block:
            number += 1
            inner.append((name, number))
        says = said(name, attrs, says)
        silent += name in SILENT or bool(attrs and hidden(attrs))
        link += name == "a"
        if name in RAW:
            raw = re.compile(f"</{name}(?=[\\s/>])", re.I | re.A).search(html, at)
            at = raw.start() if raw else end
    text_at(html[at:])
    flush()
    return out


#: Features of a block, in order: of its text and place only. What names say is no feature but added to the fitted log-odds.
FEATURES = ("link_share", "log_length", "stops", "commas", "heading", "list", "short", "bias")
#: The prior mean of the weights, before any page is seen.
PRIOR = np.array([-4.0, 1.2, 1.5, 0.5, 0.8, -0.8, -0.8, -2.2])


def features(found: list[Block]) -> np.ndarray:
    return np.array([
        [b.linked / len(b.text), np.log1p(len(b.text)) / 3, min(sum(map(b.text.count, ".!?\u3002")), 5) / 5, min(b.text.count(",") + b.text.count("\u3001"), 5) / 5,
         b.tag in HEADINGS, b.tag in ("li", "dd", "dt", "td"), len(b.text) < 30, 1.0]
        for b in found]).reshape(len(found), len(FEATURES))


def fit(pages: list[str], rounds: int = 60, pull: float = 0.05) -> np.ndarray:
    """Weights by distant supervision: what names say of a block is its label, and no feature tells it.

    Blocks of which names say nothing, or no more than words of content, teach nothing. A Gaussian prior
    about ``PRIOR`` weighs as much as the part ``pull`` of the blocks.
    """
    xs, ys = [], []
    for html in pages:
        found = blocks(html or "")
        told = [b for b in found if b.says not in ("", "words", "inner")]
        if told:
            xs.append(features(told))
            ys.append(np.array([b.says == "element" for b in told], float))
    if not xs:
        return PRIOR.copy()
    x, y = np.concatenate(xs), np.concatenate(ys)
    w, pull = PRIOR.copy(), pull * len(y) + 1.0
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - PRIOR)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _max_flow(nodes: list[int], gain: list[float], near: list[dict[int, float]], label: np.ndarray) -> None:
    """Labels of one component by a maximum flow along shortest augmenting paths."""
    place = {i: k for k, i in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    cap: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for i in nodes:
        k = place[i]
        a, b = (s, k) if gain[i] > 0 else (k, t)
        cap[a][b] = abs(gain[i])
        cap[b].setdefault(a, 0.0)
        for j, w in near[i].items():
            cap[k][place[j]] = cap[k].get(place[j], 0.0) + w
    while True:
        came: dict[int, int] = {s: s}
        queue = deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if t not in came:
            break
        flow, v = np.inf, t
        while v != s:
            flow = min(flow, cap[came[v]][v])
            v = came[v]
        v = t
        while v != s:
            u = came[v]
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow
            v = u
    for i in nodes:
        label[i] = int(place[i] in came)


def _shorten(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[tuple]:
    """Take out nodes of one or two neighbours, whose best label for each of theirs is known, and put their
    cost on those as gains and an edge; the optimum is the same. What was taken out, to be labelled in reverse."""
    out, todo = [], deque(nodes)
    gone = set()
    while todo:
        i = todo.popleft()
        if i in gone or len(near[i]) > 2:
            continue
        gone.add(i)
        ends = sorted(near[i].items())
        (a, wa), (b, wb) = (ends + [(-1, 0.0), (-1, 0.0)])[:2]
        out.append((i, gain[i], a, wa, b, wb))
        cost = lambda x, y, g=gain[i], wa=wa, wb=wb: min(wa * x + wb * y, -g + wa * (1 - x) + wb * (1 - y))
        w = max(0.0, (cost(1, 0) + cost(0, 1) - cost(0, 0) - cost(1, 1)) / 2) if b >= 0 else 0.0
        if a >= 0:
            gain[a] -= cost(1, 0) - cost(0, 0) - w
            near[a].pop(i)
        if b >= 0:
            gain[b] -= cost(0, 1) - cost(0, 0) - w
            near[b].pop(i)
            if w > 0:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        near[i] = {}
        todo.extend(k for k in (a, b) if k >= 0)
    return out


#: Blocks of a component beyond which nodes of one or two neighbours are taken out before the flow.
LONG = 256


def cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels of least cost: a node pays ``-gain`` if 1 (relative to 0), an edge its weight if it is cut.

    Nodes whose gain outweighs all their edges are settled first, which never changes the optimum. Each
    component of the rest is settled by a maximum flow; long ones are shortened first, which does not either.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    gain = [float(g) for g in gain]
    label = np.full(n, -1)
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] >= 0 or abs(gain[i]) <= sum(near[i].values()):
            continue
        label[i] = int(gain[i] > 0)
        for j, w in near[i].items():
            gain[j] += w if label[i] else -w
            near[j].pop(i, None)
            todo.append(j)
        near[i] = {}
    seen = label >= 0
    for i in range(n):
        if seen[i]:
            continue
        seen[i], nodes = True, [i]
        for k in nodes:
            for j in near[k]:
                if not seen[j]:
                    seen[j] = True
                    nodes.append(j)
        gone = _shorten(nodes, gain, near) if len(nodes) > LONG else []
        rest = set(nodes).difference(g[0] for g in gone)
        if rest:
            _max_flow(sorted(rest), gain, near, label)
        for k, g, a, wa, b, wb in reversed(gone):
            x, y = label[a] if a >= 0 else 0, label[b] if b >= 0 else 0
            label[k] = int(-g + wa * (1 - x) + wb * (1 - y) < wa * x + wb * y)
    return label


def main_text(html: str | None, weights: np.ndarray, near: float = 1.0, tree: float = 0.8) -> str:
    """Text of the blocks on the content side of the cut, joined by one space.

    A block's log-odds are the fitted ones of its text, at most ``MOST`` either way, and what names say, which is less.
    """
    found = blocks(html or "")
    if not found:
        return ""
    inner = "named" if any(b.says == "element" for b in found) else "element"
    gain = np.clip(features(found) @ weights, -MOST, MOST) + np.array([SAYS[inner if b.says == "inner" else b.says] for b in found])
    edges = []
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, near * b.low / max(found[k - 1].depth, b.depth, 1)))
        if b.parent in last:
            edges.append((last[b.parent], k, tree))
        last[b.parent] = k
    label = cut(gain, edges)
    return " ".join(b.text for b, x in zip(found, label, strict=True) if x)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sample: int = 400) -> DataFrame:
    """Each row of ``pages``: the columns ``keep``, ``text`` and ``n_chars`` (its code points).

    The model is fitted on at most ``sample`` pages (those of smallest hash). A null or empty page, or
    one without content, has an empty text. Very long, deeply nested or broken pages take time and memory
    in proportion to their length. Repeated rows repeat; other columns are not read.
    """
    names = list(keep)
    held = hash_sample(pages.select(*names, html), (html, *names), sample, pages.count())
    weights = fit([r[0] for r in held.select(html).collect()])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), weights) for h in b.column("_html")]
            new = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, *new], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema)
    return pages.select(*names, F.col(html).alias("_html")).mapInArrow(extracted, f"{schema}, text string, n_chars long")
