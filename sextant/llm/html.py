"""Main-text extraction by minimum cut.

A page is cut into blocks of text.  A linear classifier gives each block the log-odds of being content, from its text (length,
share of linked characters, sentence end, kind of block, place before the main heading) and from what its ancestors' tags and
class words say.  A positive value is the capacity from the source (what it costs to call the block boilerplate), a negative
one the capacity to the sink.  Smoothness edges join neighbouring blocks and blocks next to each other among one parent's
children, strongly inside a region and weakly across its border.  The minimum cut (Dinic's max-flow) splits content from
boilerplate, so blocks whose own evidence is weak go with their neighbours.

The text weights are fitted (``fit``): blocks that lie in an ``article`` or in a ``nav``, ``footer``, ``aside``, ``header`` or
``form`` label themselves, and a logistic regression, held near PRIOR by a ridge, learns from their text features alone.  It
sees at most ``sample`` pages, those of least hash of the id (one for each id), and 64 blocks a page (documented bounds of the fit); extraction
covers every block of every page.

Pages are handled one by one in tasks; memory is that of one page, and reading it is linear in its length.  Defined results:
null or empty html gives an empty text; a page without blocks, too; unclosed and stray tags are tolerated (an open ``head`` ends
at the first tag of a body, an open ``button`` or ``select`` at the next tag); of a tag that is never closed by ``>``, the rest
is dropped; very long pages are read whole; repeated rows repeat; an empty table gives no rows and fits nothing; columns beside
id, url and html are ignored, and url keeps its type.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sextant.llm.words import by_rows, least_hashed

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_HEADING = re.compile(r"h[1-6]")

# Tags by their role in a page, and words of class, id and role attributes with what they tell (log-odds).
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
RAW = frozenset("script style textarea title".split())
DROPPED = RAW | frozenset("noscript template svg math iframe object canvas audio video select button".split())
HOLDERS = frozenset("div article main section body ul ol nav footer aside td blockquote header form".split())
INSIDE = 4.5
TAGS = {"nav": -9.0, "footer": -8.0, "aside": -8.0, "menu": -8.0, "dialog": -8.0, "form": -7.0}
WORDS = {
    -10.0: "comment comments commentlist disqus replies reply respond",
    -8.0: "ad ads adv advert adverts advertisement advertising banner outbrain popup promo promotion sponsor sponsored taboola widget",
    -7.5: "breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright footer form gdpr login menu modal nav navbar navigation newsletter notice notices notification pagination pager search sidebar signup subscribe subscription toolbar tracking",
    -3.5: "recommended related share sharing social",
    1.5: "article articlebody body content entry main post story text",
}
SAYS = {w: v for v, words in WORDS.items() for w in words.split()}

#: Weights of the text features before the fit: constant, words (up to 60), link share, sentence end, heading, list item,
#: before the main heading, sign of rights or contact; and how far a feature's weight is held (words run to 60, others to 1).
PRIOR = np.array([-0.6, 0.045, -4.0, 0.8, 0.4, -0.5, -2.5, -3.0])
HOLD = np.array([1.0, 900.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])


@dataclass
class Block:
    text: str
    features: tuple[float, ...]
    context: float  # log-odds from the ancestors
    region: int
    parent: int
    tag: str
    label: int | None  # what its place says for sure
    inside: bool  # in an article


def self_closed(tag: str, attributes: str) -> bool:
    """A slash before ``>`` closes only elements of other vocabularies; elsewhere, and at the end of an unquoted value, it says nothing."""
    return tag in ("svg", "math") and attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\f\r\"'")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in order; comments and declarations go."""
    at, n, quoted = 0, len(page), True
    low = None
    ends: dict[str, int] = {}  # the next end tag of each dropped tag, n if there is none
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", page[at:], ""
            return
        if tag > at:
            yield "text", page[at:tag], ""
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        if page[tag + 1 : tag + 2] in ("!", "?"):
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, tag)
        if not m:
            yield "text", "<", ""
            at = tag + 1
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        if rest:
            at, attributes = rest.end(), page[m.end() : rest.end() - 1]
        else:
            quoted = False  # some quote never closes: from here on, tags end at the next ">"
            end = page.find(">", m.end())
            if end < 0:
                return
            at, attributes = end + 1, page[m.end() : end]
        name = m[2].lower()
        yield ("close" if m[1] else "open"), name, attributes
        if not m[1] and name in DROPPED and not self_closed(name, attributes):
            low = page.lower() if low is None else low
            if len(low) != n:  # a letter whose lower case is longer: positions would differ
                low = page.translate(_ASCII_LOWER)
            if ends.get(name, -1) < at:
                found = low.find("</" + name, at)
                ends[name] = n if found < 0 else found
            end = ends[name]
            if name not in RAW and 0 <= low.find("<" + name, at, end):
                end = n  # opened again before it was closed
            if end < n:
                at = end
            elif name in RAW:
                return
            else:
                end = page.find("<", at)
                at = n if end < 0 else end


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order."""
    out: list[Block] = []
    # open elements: tag, number, best and worst evidence, region, surely content (1) or not (0), in an article
    stack: list[tuple[str, int, float, float, int, int | None, bool]] = [("", 0, 0.0, 0.0, 0, None, False)]
    number, words, linked, links, headings = 0, [], 0, 0, 0
    in_head = False

    def close() -> None:
        nonlocal words, linked, headings
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            own = next((t for t, *_ in reversed(stack) if t in BLOCKS), "")
            main = own == "h1"
            headings += main
            share = min(1.0, linked / max(1, sum(map(len, words))))
            count = text.count(" ") + 1
            end = count >= 4 and text[-1] in ".!?…:;\"»”。！？"
            features = (1.0, float(min(count, 60)), share, float(end), 1.0 if main else 0.5 * bool(_HEADING.fullmatch(own)), float(own == "li"), float(not headings), float("©" in text or "®" in text or "@" in text and count < 30))
            _, _, up, down, region, label, inside = stack[-1]
            holder = next((k for t, k, *_ in reversed(stack) if t in HOLDERS), 0)
            out.append(Block(text, features, down if down < -5 else up + down, region, holder, own, label, inside))
        words, linked = [], 0

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            if in_head:
                if not tag.strip():
                    continue
                in_head = False
            words.append(tag)
            if links:
                linked += len(tag)
            continue
        if kind == "close":
            if tag == "head":
                in_head = False
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                close()
            if tag in ("head", "html", "body") or tag in DROPPED:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body", "td", "section") and tag not in BLOCKS:
                    break
            continue
        if tag in DROPPED:
            words.append(" ")
            continue
        if tag == "head":
            in_head = True
            continue
        if in_head and tag in HEAD:
            continue
        in_head = False
        if tag in BLOCKS:
            close()
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or _HEADING.fullmatch(tag):
                while len(stack) > 1 and (stack[-1][0] in ("p", tag) or stack[-1][0] not in BLOCKS):
                    stack.pop()
            elif tag in ("article", "main", "section", "div", "ul", "ol", "table", "form", "aside", "nav", "footer", "header", "blockquote"):
                while len(stack) > 1 and stack[-1][0] == "p":
                    stack.pop()
        if tag in VOID or self_closed(tag, attributes):
            if tag == "br":
                words.append(" ")
            continue
        if tag == "a":
            links += 1
        number += 1
        _, _, up, down, region, label, inside = stack[-1]
        says = [SAYS[w] for g in _HINT.findall(attributes) for w in _PART.findall("".join(g).lower()) if w in SAYS] if "=" in attributes else []
        if tag in ("article", "main"):
            if down == TAGS["form"]:  # a form around the whole page says nothing
                down, label = 0.0, None
            up, region, label, inside = max(up, INSIDE), number, 1 if label is None else label, True
        elif tag == "header" and not inside:
            down, region, label = min(down, -7.0), number, 0
        elif tag in TAGS:
            down, region, label = min(down, TAGS[tag]), number, 0
        if says and tag not in ("html", "body", "article", "main"):
            worst = min(says)
            if worst < 0:
                down, region, label = min(down, worst), number, None if label == 1 else label
            elif not down:
                up, region = max(up, worst), number
        stack.append((tag, number, up, down, region, label, inside))
    close()
    if not headings:  # nothing lies before a heading that isn't there
        for b in out:
            b.features = (*b.features[:6], 0.0, b.features[7])
    return out


def log_odds(block: Block, weights: np.ndarray, outside: bool) -> float:
    """``outside``: the page has an article and the block isn't in one."""
    return float(np.dot(block.features, weights)) + block.context - 2.0 * outside


def content(values: list[float], found: list[Block], near: float = 0.8, kin: float = 1.0, alike: float = 0.4, border: float = 0.1) -> list[bool]:
    """True for each block on the source's side of the minimum cut."""
    n = len(found)
    if not n:
        return []
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    last: dict[int, int] = {}
    for i, (value, b) in enumerate(zip(values, found, strict=True)):
        if value > 0:
            join(s, i, value, 0)
        else:
            join(i, t, -value, 0)
        if i:
            weight = border if found[i - 1].region != b.region else near if found[i - 1].parent == b.parent else near / 2
            join(i - 1, i, weight, weight)
        if (j := last.get(b.parent)) is not None:
            weight = (kin + alike * (found[j].tag == b.tag)) if found[j].region == b.region else border
            join(j, i, weight, weight)
        last[b.parent] = i
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        order = [s]
        for a in order:
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    order.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        here = s
        while True:
            if here == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                here = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[here] < len(head[here]):
                e = head[here][at[here]]
                if room[e] > 1e-9 and level[to[e]] == level[here] + 1:
                    break
                at[here] += 1
            else:
                if not path:
                    break
                e = path.pop()
                here = to[e ^ 1]
                at[here] += 1
                continue
            path.append(e)
            here = to[e]


def labelled(page: str | None, weights: np.ndarray = PRIOR) -> list[tuple[Block, bool, bool]]:
    """Each block with the classifier's own label and the cut's."""
    found = blocks(page or "")
    article = any(b.inside for b in found)
    values = [log_odds(b, weights, article and not b.inside) for b in found]
    return [(b, v > 0, keep) for b, v, keep in zip(found, values, content(values, found), strict=True)]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    return "\n".join(b.text for b, _, keep in labelled(page, weights) if keep)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps on classes of equal weight, drawn to PRIOR; PRIOR itself if a class is missing."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * HOLD * (w - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.diag(HOLD)
        move = np.linalg.solve(curve, gradient)
        w = w - move * min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 1000, per_page: int = 64) -> np.ndarray:
    """Text weights from the blocks of a bounded sample of pages whose place labels them."""
    chosen = least_hashed(pages.select(id_col, html_col), [id_col], sample).repartition(8)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, page in rows:
            known = [b for b in blocks(page or "") if b.label is not None]
            yield from ((b.label, list(b.features)) for b in known[:per_page])

    got = sorted(by_rows(chosen, run, "y int, x array<double>").collect())
    return fit_weights(np.array([r.x for r in got]).reshape(-1, len(PRIOR)), np.array([r.y for r in got]))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """id and main text of every page."""
    use = fit(pages, id_col, html_col) if weights is None else weights
    extra = [c for c in ("url",) if c in pages.columns and c not in (id_col, html_col)]
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(id_col, *extra).schema}

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *keys, page in rows:
            yield *keys, main_text(page, use)

    return by_rows(pages.select(id_col, *extra, html_col), run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", text string", out=256)
