"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages the classifier is fitted on and blocks taken of each.
FIT_PAGES, FIT_BLOCKS = 400, 200

#: Elements whose content is no text of the page.
_SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "button", "canvas", "audio", "video"}
_RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
#: What may stand in a head; anything else ends one that is open.
_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head"}
#: Elements that, like those, do not end a block.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "br", "td", "th", "picture", "source", "o:p"}
_INLINE |= {"math", "semantics", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SPACE = {"br", "td", "th", "img", "input", "mtd"}
#: An element that opens ends these, up to the nearest of the limits.
_ENDS = {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "main": "main", "article": "article"}
#: Words of class and id attributes.
_BAD = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|foot(?:er)?|masthead|topbar|side(?:bar)?|widget\w*|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|paywall|toolbar|pagination|pager|copyright|legal|disclaimer|skip)(?![a-z])")
_COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|respond|repl(?:y|ies)|disqus|discussion|reactions?|reviews)(?![a-z])")
_GOOD = re.compile(r"(?:^|[^a-z])(?:article|main|content|post|entry|story|body|text)(?![a-z])")
#: Words of a class that tell of a page's state or subject, not of what the element is.
_STATE = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|is|tag|category|cat|term|tax|type|format|status|layout|template)[-_]\S*")
#: Of the bad words, those that name what never is the article, however much text it holds.
_NEVER = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|newsletter|subscribe|login|signup|paywall|copyright|breadcrumbs?|pagination|pager)(?![a-z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Hints of the place of a block, as bits of its elements.
HINTS = ("nav", "footer", "aside", "header", "form", "bad", "comment", "hidden", "article", "good")
_BIT = {name: 1 << i for i, name in enumerate(HINTS)}

FEATURES = (*HINTS, "paragraph", "heading", "item", "length", "links", "stop", "bias")
#: What the fit starts from and is held near to, in the order of FEATURES: a sign or a word a
#: sample lacks still counts.
_PRIOR = np.array([-9, -9, -9, -8, -9, -9, -11, -11, 3, 1, 0.7, 0.6, -0.4, 0.5, -2.5, 0.5, 0.0])
_HELD = np.array([300.0] * len(HINTS) + [3.0, 3.0, 300.0, 3.0, 3.0, 3.0, 3.0])
#: Weights of the edges between blocks: next in page order, and next under one parent.
NEXT, SIBLING = 1.0, 1.0


#: A wrapper with so much of the page's text outside links is its layout, and an article with
#: so much of it is the page's own.
MOST_TEXT, ARTICLE_TEXT = 0.5, 0.3


@dataclass
class Element:
    name: str
    parent: int  # number of the element around it, -1 for none
    depth: int  # block elements around it and itself
    hints: int  # of its own
    inside: bool  # in an article
    never: bool  # words that no amount of text outweighs
    main: bool
    text: int = 0  # characters outside links, with all it holds


@dataclass
class Block:
    text: str
    hints: int
    tag: str
    element: int  # number of the block element around it, -1 for none
    link_chars: int


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, decoded, white space turned into one space."""
    return parsed(page)[0]


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of a page in order and its elements, in time that grows with the page alone."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []  # numbers of the open elements
    opened: Counter[str] = Counter()
    silent = 0
    parts: list[str] = []
    links: list[str] = []
    in_link = 0

    def name_of(i: int) -> str:
        return elements[stack[i]].name

    def close_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inner = stack[-1] if stack else -1
                out.append(Block(text, 0, "body", inner, min(len("".join(links)), len(text))))
            parts.clear()
            links.clear()

    def pop_to(i: int) -> None:
        nonlocal silent, in_link
        for number in stack[i:]:
            name = elements[number].name
            opened[name] -= 1
            silent -= name in _SILENT
            in_link -= name == "a"
        del stack[i:]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            data, after = page[at:], len(page)
        else:
            data, after = page[at : m.start()], m.end()
        if stack and name_of(-1) == "head" and data.strip():
            pop_to(len(stack) - 1)
        if data and not silent:
            parts.append(data)
            if in_link:
                links.append(data)
        at = after
        if m is None or m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in _INLINE and name not in _SILENT:
                close_block()
            elif name in _SPACE and not silent:
                parts.append(" ")
            if opened[name]:
                i = len(stack) - 1
                while name_of(i) != name:
                    i -= 1
                # an inline element does not end the blocks around it
                if name not in _INLINE or all(elements[n].name in _INLINE for n in stack[i:]):
                    pop_to(i)
                else:
                    in_link -= name == "a"
                    opened[name] -= 1
                    del stack[i]
            continue
        if stack and name_of(-1) == "head" and name not in _HEAD:
            pop_to(len(stack) - 1)
        if name not in _INLINE and name not in _SILENT:
            close_block()
            if opened["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if name_of(i) == "p":
                        pop_to(i)
                        break
                    if name_of(i) not in _INLINE:
                        break
        elif name in _SPACE and not silent:
            parts.append(" ")
        if name in _ENDS:
            ended, limits = _ENDS[name]
            i = len(stack) - 1
            while i >= 0 and any(opened[e] for e in ended) and name_of(i) not in limits:
                if name_of(i) in ended:
                    pop_to(i)
                i -= 1
        if name in _VOID or m[3].endswith("/"):
            continue
        around = elements[stack[-1]] if stack else None
        depth = (around.depth if around else 0) + (name not in _INLINE)
        inside = bool(around and around.inside)
        hints, never, main = _hints_of(name, m[3], inside)
        stack.append(len(elements))
        elements.append(Element(name, stack[-2] if around else -1, depth, hints, inside or bool(hints & _BIT["article"]), never, main))
        opened[name] += 1
        silent += name in _SILENT
        in_link += name == "a"
        if name in _RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    close_block()
    _weigh(out, elements)
    return out, elements


def _hints_of(name: str, attributes: str, inside: bool) -> tuple[int, bool, bool]:
    """The hints of an element's own tag and attributes, whether its words are those of _NEVER, whether it is a main."""
    hints, never = 0, False
    role, words = name, ""
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if key.lower() == "role":
                role = _ROLES.get(value, role)
            else:
                words += " " + value
        if _HIDDEN.search(attributes):
            hints |= _BIT["hidden"]
    if role in ("article", "main"):
        hints |= _BIT["article"]
    elif role in ("nav", "footer", "aside", "form") or role == "header" and not inside:
        hints |= _BIT[role]
    # the root elements carry words about the whole page
    if words and name not in ("html", "body"):
        words = _STATE.sub("", words)
        hints |= _BIT["comment"] if _COMMENTS.search(words) else 0
        hints |= _BIT["bad"] if _BAD.search(words) else 0
        hints |= _BIT["good"] if _GOOD.search(words) else 0
        never = _NEVER.search(words) is not None
    return hints, never, role == "main"


def _weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Gives each block the hints of the elements around it, wrappers judged by what they hold.

    The page's own article is its `main`, or the article with the most text outside links if
    that is ARTICLE_TEXT of the page's; an article whose words say comment is none. An element
    that is or holds it says nothing bad by its words or by being a form: the theme's widget,
    the column beside a sidebar, the form around a whole page. Neither does one that holds
    MOST_TEXT of the page's text outside links and less text in links, unless its words are
    of _NEVER or say comment.
    """
    linked = [0] * len(elements)
    total = 0
    for b in blocks:
        total += len(b.text) - b.link_chars
        if b.element >= 0:
            elements[b.element].text += len(b.text) - b.link_chars
            linked[b.element] += b.link_chars
    for i in range(len(elements) - 1, -1, -1):  # what is inside has the greater number
        above = elements[i].parent
        if above >= 0:
            elements[above].text += elements[i].text
            linked[above] += linked[i]
    words = _BIT["bad"] | _BIT["comment"]
    own = [i for i, e in enumerate(elements) if e.hints & _BIT["article"] and not e.hints & _BIT["comment"]]
    mains = [i for i in own if elements[i].main and elements[i].text]
    large = [i for i in own if elements[i].text >= ARTICLE_TEXT * total > 0]
    i = max(mains or large, key=lambda i: elements[i].text, default=-1)
    while i >= 0:
        elements[i].hints &= ~(words | _BIT["form"])
        i = elements[i].parent
    for i, e in enumerate(elements):
        if e.text >= MOST_TEXT * total > 0 and e.text > linked[i] and not e.never and not e.hints & _BIT["comment"]:
            e.hints &= ~(_BIT["bad"] | _BIT["form"])
    around: list[int] = []
    for e in elements:
        around.append(e.hints | (around[e.parent] if e.parent >= 0 else 0))
    outer: list[int] = []  # the nearest block element
    for i, e in enumerate(elements):
        outer.append(i if e.name not in _INLINE else outer[e.parent] if e.parent >= 0 else -1)
    for b in blocks:
        if b.element >= 0:
            b.hints = around[b.element]
            b.element = outer[b.element]
            b.tag = elements[b.element].name if b.element >= 0 else "body"


def features(blocks: list[Block]) -> np.ndarray:
    rows = []
    for b in blocks:
        size = len(b.text)
        rows.append(
            [b.hints >> i & 1 for i in range(len(HINTS))]
            + [
                b.tag in ("p", "blockquote", "pre"),
                len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(),
                b.tag in ("li", "dd", "dt"),
                min(math.log1p(size) / 3, 2.5),
                min(b.link_chars / size, 1.0),
                b.text[-1] in ".!?。…",
                1.0,
            ]
        )
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def _truth(hints: int) -> float | None:
    """What the page's own landmarks say of a block; None if they say nothing."""
    bad = hints & ~(_BIT["article"] | _BIT["good"])
    if bad:
        return 0.0
    return 1.0 if hints & _BIT["article"] else None


def fit(pages: DataFrame, most: int = FIT_PAGES) -> np.ndarray:
    """Weights of a logistic classifier learned from the landmarks of at most `most` pages.

    Every block is learned with and without the hints of its place, so that text and tags also
    count on pages without landmarks.
    """
    picked = pages.select("page_id").where("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    some = pages.select("page_id", "html").join(F.broadcast(picked.select(F.col("page_id").alias("p"))), F.col("page_id") == F.col("p"), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(*batch.columns, strict=True):
                blocks = blocks_of(page.as_py() or "")[:FIT_BLOCKS]
                known = [(b, _truth(b.hints)) for b in blocks if _truth(b.hints) is not None]
                x = features([b for b, _ in known])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page_id.as_py()]), pa.array([x.tobytes()]), pa.array([[t for _, t in known]], pa.list_(pa.float64()))],
                    ["page_id", "x", "y"],
                )

    rows = some.mapInArrow(read, "page_id long, x binary, y array<double>").orderBy("page_id", "x").limit(most).collect()
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, len(FEATURES)) for r in rows] or [np.zeros((0, len(FEATURES)))])
    y = np.concatenate([np.array(r["y"], np.float64) for r in rows] or [np.zeros(0)])
    bare = x.copy()
    bare[:, : len(HINTS)] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    weights = _PRIOR.copy()
    if not len(x):
        return weights
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * 100
    # the landmarks made the truth, so they separate it perfectly, and a
    # sample's lists may all be menus: these weights are held firmly
    for _ in range(25):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + _HELD * (weights - _PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(_HELD)
        weights = weights - np.linalg.solve(curve, slope)
    return weights


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    A positive score is the capacity from the source, a negative one that to the sink; edges
    hold in both directions. A node whose terminal outweighs all its edges is on that side
    of every minimum cut, so it is settled first; max-flow decides about the rest.
    """
    n = len(scores)
    score = list(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(score[i]) >= sum(around[i].values()):
            side[i] = score[i] > 0
            for j, w in around[i].items():
                score[j] += w if side[i] else -w
                del around[j][i]
                todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, content in zip(rest, _max_flow(rest, score, around), strict=True):
            side[i] = content
    return [bool(s) for s in side]


def _max_flow(rest: list[int], score: list[float], around: list[dict[int, float]]) -> list[bool]:
    """The source side by blocking flows over layers; a layer's dead ends are left once."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        room[i] = dict(around[i])
    for i in rest:
        a, b = (source, i) if score[i] > 0 else (i, sink)
        room[a][b] = abs(score[i])
        room[b].setdefault(a, 0.0)
    while True:
        layer = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, free in room[u].items():
                if free > 1e-12 and v not in layer:
                    layer[v] = layer[u] + 1
                    queue.append(v)
        if sink not in layer:
            return [i in layer for i in rest]
        onward = {u: iter(list(room[u])) for u in layer}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                # go on from the first edge that is full now
                del path[next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-12) + 1 :]
                continue
            for v in onward[u]:
                if room[u][v] > 1e-12 and layer.get(v) == layer[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def _steps_apart(elements: list[Element], a: int, b: int) -> int:
    """Block elements to be left and entered between two places. Blocks in page order take
    each element of the tree once down and once up, so all steps of a page are linear."""
    steps = 0
    while a != b:
        if a > b:  # what is inside has the greater number
            a, b = b, a
        steps += elements[b].name not in _INLINE
        b = elements[b].parent
    return steps


def content_of(page: str, weights: np.ndarray) -> tuple[list[Block], list[bool]]:
    """Blocks of a page and which of them are content."""
    blocks, elements = parsed(page)
    if not blocks:
        return [], []
    scores = np.clip(features(blocks) @ weights, -12, 12).tolist()
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            # nearness in the tree: the fewer steps apart, the stronger
            edges[i - 1, i] = NEXT / (1 + _steps_apart(elements, blocks[i - 1].element, b.element))
        parent = elements[b.element].parent if b.element >= 0 else -2
        while parent >= 0 and elements[parent].name in _INLINE:
            parent = elements[parent].parent
        if parent in last:
            key = (last[parent], i)
            edges[key] = edges.get(key, 0.0) + SIBLING / 2
        last[parent] = i
    return blocks, min_cut(scores, edges)


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """All rows (every column) plus main_text and main_blocks, the number of its blocks.

    Null or empty html, or no content: the empty text. Unclosed comments, scripts and tags run
    to the end of the page. Very long pages are read whole. Repeated rows: the same answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for page in batch.column(batch.schema.get_field_index("html")):
                blocks, content = content_of(page.as_py() or "", weights)
                kept = [b.text for b, c in zip(blocks, content, strict=True) if c]
                texts.append("\n\n".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                [*batch.schema.names, "main_text", "main_blocks"],
            )

    schema = T.StructType(list(pages.schema.fields)).add("main_text", "string").add("main_blocks", "long")
    return pages.mapInArrow(run, schema)
