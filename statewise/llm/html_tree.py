"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and their runs of text are nodes with two labels, content or not.
A node has a potential from its tag, the words of its class and id and the shape
of its text; an edge has a potential for each pair of labels of parent and child.
Messages go up from the leaves and down from the root once (sum-product), which
gives the exact marginal of every node; runs of text that are rather content than
not are the main text. Weights are fitted by gradient on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.common import texts_of
from statewise.llm.html_labels import labelled_pages

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")

# Kinds of elements by the HTML standard.
HIDDEN = frozenset("script style title noscript template textarea svg math iframe object select head".split())
RAW = frozenset("script style title noscript template textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Page:
    """Nodes of a page in document order: parents come before children.

    ``tag`` is "#" for a run of text. ``names``: words of class, id and role.
    """

    __slots__ = ("parent", "tag", "names", "text", "linked", "label")

    def __init__(self):
        self.parent, self.tag, self.names, self.text, self.linked, self.label = [-1], ["root"], [()], [None], [0], [0]

    def add(self, parent: int, tag: str, names: tuple = (), label: int = 0) -> int:
        self.parent.append(parent), self.tag.append(tag), self.names.append(names), self.text.append(None), self.linked.append(0), self.label.append(label)
        return len(self.tag) - 1


def parse(source: str, labelled: bool = False) -> Page:
    """The tree of block elements and runs of text; any input gives a tree.

    ``labelled`` pages mark content with ``data-y``, which means nothing elsewhere. Inline elements belong to their block. Missing end tags are implied as the
    standard says; an end tag without a start is passed over.
    """
    page, stack, pieces, linked, in_link = Page(), [0], [], 0, False
    at, end = 0, len(source)
    opened: dict[str, int] = {}  # tags on the stack

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = page.add(stack[-1], "#", page.names[stack[-1]][:0], page.label[stack[-1]])
                page.text[node], page.linked[node] = text, linked
        linked = 0

    def close(tags, within=()):
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[i]]
            if tag in tags:
                flush()
                for node in stack[i:]:
                    opened[page.tag[node]] -= 1
                del stack[i:]
                return
            if tag in within:
                return

    def take(a, b):
        nonlocal linked
        if b > a:
            text = source[a:b]
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(text)

    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            take(at, end)
            break
        take(at, m.start())
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        closing = bool(m.group(1) or m.group(4))
        if name in RAW and not closing:
            done = re.compile(rf"</{name}[^>]*>", re.IGNORECASE).search(source, at)
            at = done.end() if done else end
            continue
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in INLINE:
            continue
        elif closing:
            in_link = False
            if name not in VOID:
                close((name,))
        else:
            in_link = False
            if name in VOID and name != "hr":
                continue
            if name in CLOSES_P:
                close(("p",), ("table", "td", "th", "button"))
            if name in SIBLINGS:
                tags, within = SIBLINGS[name]
                close(tags.split(), within)
            flush()
            if name == "hr":
                continue
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3) or m.group(6) or "")}
            label = found.pop("data-y", None)
            words = tuple(dict.fromkeys(w for v in found.values() for w in NAME_WORD.findall(v.lower())))
            node = page.add(stack[-1], name, words, int(label) if labelled and label is not None else page.label[stack[-1]])
            if not (m.group(3) or m.group(6) or "").rstrip().endswith("/") or name not in ("svg",):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
    flush()
    return page


def traits(page: Page, i: int) -> list[str]:
    """Names of the features of a node."""
    tag = page.tag[i]
    if tag != "#":
        return ["tag " + tag, *["name " + w for w in page.names[i]]]
    text = page.text[i]
    n = len(text)
    share = page.linked[i] / n
    return [
        f"size {min(5, int(math.log2(n + 1) / 1.6))}",
        "link none" if share == 0 else "link some" if share < 0.5 else "link most",
        "ends sentence" if text[-1] in ".!?…。！？\"»”" else "ends open",
        "in " + page.tag[page.parent[i]],
        *(["mark ©"] if "©" in text else []),
    ]


class Model:
    """Weights of features, and of label pairs for edges to elements and to text."""

    def __init__(self, weights: dict[str, float], edges: list[list[float]]):
        self.weights, self.edges = weights, edges  # edges: for each kind (parent 0 child 1, parent 1 child 0, parent 1 child 1)

    def potentials(self, page: Page) -> list[float]:
        get = self.weights.get
        return [sum(get(t, 0.0) for t in traits(page, i)) for i in range(len(page.tag))]

    def marginals(self, page: Page, pairs: bool = False):
        """P(content) of each node; with ``pairs`` also, for each edge, P of the three label pairs."""
        n, parent, tag = len(page.tag), page.parent, page.tag
        unary = self.potentials(page)
        up0, up1 = [0.0] * n, unary  # sums of what comes from below, by the node's label
        to0, to1 = [0.0] * n, [0.0] * n  # messages to the parent, by the parent's label
        for i in range(n - 1, 0, -1):
            e01, e10, e11 = self.edges[tag[i] == "#"]
            a, b = up0[i], up1[i]
            x, y = a, b + e01
            to0[i] = m0 = (x if x > y else y) + math.log1p(math.exp(-abs(x - y)))
            x, y = a + e10, b + e11
            to1[i] = m1 = (x if x > y else y) + math.log1p(math.exp(-abs(x - y)))
            p = parent[i]
            up0[p] += m0
            up1[p] += m1
        down0, down1 = [0.0] * n, [0.0] * n
        out = [0.0] * n
        joint = [None] * n
        for i in range(n):
            if i:
                p = parent[i]
                a, b = up0[p] + down0[p] - to0[i], up1[p] + down1[p] - to1[i]  # the parent without this child
                e01, e10, e11 = self.edges[tag[i] == "#"]
                x, y = a, b + e10
                d0 = (x if x > y else y) + math.log1p(math.exp(-abs(x - y)))
                x, y = a + e01, b + e11
                d1 = (x if x > y else y) + math.log1p(math.exp(-abs(x - y)))
                down0[i], down1[i] = d0, d1
                if pairs:
                    logs = (a + up0[i], a + e01 + up1[i], b + e10 + up0[i], b + e11 + up1[i])
                    top = max(logs)
                    ex = [math.exp(v - top) for v in logs]
                    s = sum(ex)
                    joint[i] = (ex[1] / s, ex[2] / s, ex[3] / s)
            z = up0[i] + down0[i] - up1[i] - down1[i]
            out[i] = 1 / (1 + math.exp(z)) if z < 700 else 0.0
        return (out, joint) if pairs else out

    def text(self, page: Page) -> str:
        if len(page.tag) == 1:
            return ""
        content = self.marginals(page)
        hidden = [False] * len(page.tag)
        out = []
        for i in range(1, len(page.tag)):
            hidden[i] = hidden[page.parent[i]] or page.tag[i] in HIDDEN
            if page.tag[i] == "#" and content[i] >= 0.5 and not hidden[i]:
                out.append(page.text[i])
        return "\n".join(out)


def fit(pages: list[str], rounds: int = 60, rate: float = 0.2, ridge: float = 0.02) -> Model:
    """Conditional likelihood of the labels by Adam; expectations from the two message passes."""
    parsed = [parse(p, labelled=True) for p in pages]
    names = sorted({t for p in parsed for i in range(len(p.tag)) for t in traits(p, i)})
    place = {t: i for i, t in enumerate(names)}
    found = [[[place[t] for t in traits(p, i)] for i in range(len(p.tag))] for p in parsed]
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        model = Model(dict(zip(names, theta.tolist(), strict=False)), [theta[-6:-3].tolist(), theta[-3:].tolist()])
        grad = -ridge * theta
        for page, at in zip(parsed, found, strict=True):
            p, joint = model.marginals(page, pairs=True)
            for i in range(len(page.tag)):
                y = page.label[i]
                grad[at[i]] += y - p[i]
                if i:
                    x = page.label[page.parent[i]]
                    k = len(names) + 3 * (page.tag[i] == "#")
                    j = joint[i]
                    grad[k] += (x == 0 and y == 1) - j[0]
                    grad[k + 1] += (x == 1 and y == 0) - j[1]
                    grad[k + 2] += (x == 1 and y == 1) - j[2]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(names, theta.tolist(), strict=False)), [theta[-6:-3].tolist(), theta[-3:].tolist()])


@cache
def trained() -> tuple[dict[str, float], list[list[float]]]:
    model = fit(labelled_pages())
    return model.weights, model.edges


def main_text(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``df``.

    White space inside a block becomes one space, blocks are joined by a line
    feed in page order, ``n_chars`` counts code points. A null or empty page has
    the empty text; broken mark-up is read as far as it goes; pages of any length
    are read whole. Null and repeated ids and repeated rows keep a row each; other
    columns are not read. An empty table gives an empty result.
    """
    weights, edges = trained()
    kinds = dict(df.dtypes)

    def scan(batches):
        model = Model(weights, edges)
        for batch in batches:
            texts = [model.text(parse(t)) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["_id", "_url", "_text", "_n"])

    found = df.select(id_column, url_column, html_column).mapInArrow(scan, f"_id {kinds[id_column]}, _url {kinds[url_column]}, _text string, _n long")
    return found.select(F.col("_id").alias(id_column), F.col("_url").alias(url_column), F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
