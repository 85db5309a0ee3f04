"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and the text blocks in them. Each is main text or not; a node's
own potential comes from its tag, its class and id words, its length and how much of it is links, and
an edge's potential from the labels of parent and child. Sum-product messages go from the leaves up
and from the root down, and the marginals they give decide for each text block. The weights maximise
the likelihood of labelled pages, with the same messages giving the expected counts.

A batch's pages form one forest, and messages are passed for all nodes of a depth at once.

The parser passes every character once, whatever is left unclosed.

Defined results: a page that is null, empty or without main text gives an empty text. Unclosed and
stray tags are mended as browsers do in the common cases. Character references are decoded, white space
inside a block (line breaks too) becomes one space, and blocks are joined in page order by a line end.
Rows are handled one by one: ties, repeated rows and null keys pass through, other columns are not read. An
empty table has no rows; nesting beyond DEEPEST blocks is flattened, and a very long page takes time in proportion.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.labelled_pages import labelled_pages

# Elements that stand as blocks, have no end tag, or hold no text to read.
BLOCKS = frozenset("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in "script style noscript template iframe svg math title object canvas audio video".split()}
#: Which open elements a new one ends, and what bounds the search for them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Elements that ask for an answer, and words that open what is not main text.
ASKS = frozenset("form input button textarea select label".split())
CUES = frozenset("reply comments comment advertisement sponsored share subscribe copyright © cookies login search menu kommentare commentaires comentarios anzeige".split())
#: A page with a block of so many words has main text.
ENOUGH = 20
#: Deepest nesting of blocks; what would lie deeper hangs on the deepest, as browsers have it.
DEEPEST = 512
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)|[!?/])", re.I)
_MARK = re.compile(r"""=\s*(["'])|>""")
_NAMES = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CUE = re.compile(r"[^\W\d_]+|©")


def tokens(source: str) -> Iterator[tuple[str, bool, str, str]]:
    """What stands before each tag, whether it is an end tag, its name and its attributes; last what stands after all tags, with an empty name.

    Every character is passed once: a quote or a tag that doesn't end is sought only once, a tag without an end goes to the end of the page, and one with an
    unclosed quote to its first ">".
    """
    at = begin = 0
    closed = {'"': True, "'": True}
    while m := _OPEN.search(source, begin):
        text, begin = source[at : m.start()], m.end()
        if m["comment"]:
            end = source.find("-->", m.end() - 2)
            at = begin = len(source) if end < 0 else end + 3
            yield text, False, "", ""
            continue
        while mark := _MARK.search(source, begin):
            begin = mark.end()
            if not mark[1]:
                break
            if closed[mark[1]]:
                end = source.find(mark[1], begin)
                closed[mark[1]] = end >= 0
                begin = end + 1 if end >= 0 else begin
        if not mark:
            yield text, False, "", ""
            return
        at, tag, rest = begin, (m["tag"] or "").lower(), source[m.end() : begin - 1]
        yield text, bool(m["close"]), tag, rest
        if tag in UNREAD and not m["close"] and not (tag in ("svg", "math") and rest.endswith("/")):
            end = UNREAD[tag].search(source, begin)
            at = begin = end.end() if end else len(source)
    yield source[at:], False, "", ""


@dataclass
class Page:
    """Nodes in page order, a parent before its children; a text block has its text, an element None."""

    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)  # data-main of labelled pages, -1 where not given

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str | None = None, links: int = 0, mark: int = -1) -> int:
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.tags.append(tag)
        self.names.append(names)
        self.texts.append(text)
        self.link_chars.append(links)
        self.marks.append(mark)
        return len(self.parents) - 1


def parse(source: str) -> Page:
    page = Page()
    stack = [page.add(-1, "#page")]
    open_tags: Counter[str] = Counter()
    run: list[str] = []
    links = in_link = 0

    def shut(depth: int) -> None:
        open_tags.subtract(page.tags[x] for x in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        nonlocal links
        if run and (text := " ".join("".join(run).split())):
            page.add(stack[-1], "#text", (), text, min(links, len(text)))
        run.clear()
        links = 0

    def read(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            links += len(piece.strip()) * (in_link > 0)

    for text, close, tag, rest in tokens(source):
        read(text)
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            in_link = 0 if close else 1
        elif tag in BLOCKS:
            flush()
            if close:
                if open_tags[tag]:
                    shut(next(k for k in range(len(stack) - 1, 0, -1) if page.tags[stack[k]] == tag))
                continue
            if page.tags[stack[-1]] == "p":
                shut(len(stack) - 1)
            if tag in ENDS:
                ended, bounds = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in ended) else ():
                    if page.tags[stack[k]] in bounds:
                        break
                    if page.tags[stack[k]] in ended:
                        shut(k)
                        break
            names, mark = [], -1
            if "=" in rest:
                for key, *values in _NAMES.findall(rest):
                    value = "".join(values)
                    if key.lower() == "data-main":
                        mark = int(value == "1")
                    else:
                        names += _SPLIT.split(value.lower())
            node = page.add(stack[-1], tag, tuple(x for x in names if x), mark=mark)
            if tag not in VOID and len(stack) < DEEPEST:
                stack.append(node)
                open_tags[tag] += 1
    flush()
    return page


@dataclass
class Forest:
    """Many pages' nodes as arrays: parent (-1 for a root), depth, whether a text block, and features by node."""

    parent: np.ndarray
    depth: np.ndarray
    leaf: np.ndarray
    node: np.ndarray  # of each feature
    feature: np.ndarray
    by_depth: list[np.ndarray]


def features(page: Page) -> list[list[str]]:
    """What each node's own potential depends on: tag, names, links and length, and how it stands among its siblings and to the first heading."""
    n = len(page.parents)
    own = [0 if t is None else len(t) for t in page.texts]
    chars, links, blocks = list(own), list(page.link_chars), [int(t is not None) for t in page.texts]
    heads, asks = [t == "h1" for t in page.tags], [t in ASKS for t in page.tags]
    first_head = next((i for i in range(n) if heads[i]), n)
    alike: Counter[tuple] = Counter()
    largest: dict[int, int] = {}
    for i in range(n - 1, 0, -1):  # children come after parents
        p = page.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        blocks[p] += blocks[i]
        heads[p] |= heads[i]
        asks[p] |= asks[i]
        alike[p, page.tags[i], page.names[i]] += 1
        if p not in largest or chars[i] >= chars[largest[p]]:
            largest[p] = i
    whole = max(1, chars[0])
    out = []
    for i in range(n):
        p = page.parents[i]
        share = f"links:{0 if not chars[i] else min(3, 4 * links[i] // chars[i])}"
        if page.texts[i] is not None:
            text = page.texts[i]
            out.append(["text", f"in:{page.tags[p]}", "text " + share, f"length:{min(9, len(text).bit_length())}", f"stop:{text[-1] in '.!?:;,'}", *(f"cue:{w}" for w in _CUE.findall(text[:60].lower())[:4] if w in CUES)])
        else:
            side = "only" if p < 0 or len(largest) == 0 or chars[largest[p]] == chars[p] else "largest" if largest[p] == i else "before" if i < largest[p] else "after"
            names = page.names[i]
            out.append([f"tag:{page.tags[i]}", "element " + share, f"part:{4 * chars[i] // whole}", f"under:{page.tags[p]}" if p >= 0 else "root", f"side:{side}", f"blocks:{min(4, blocks[i].bit_length())}",
                        f"alike:{min(3, alike[p, page.tags[i], names])}", f"h1:{'in' if heads[i] else 'after' if i > first_head else 'before'}", f"asks:{asks[i]}", f"named:{bool(names)}", *(f"name:{x}" for x in names), *(f"stem:{x[:5]}" for x in names)])
    return out


def forest(pages: list[Page], vocabulary: dict[str, int]) -> Forest:
    parent, node, feature, at = [], [], [], 0
    for page in pages:
        parent += [p + at if p >= 0 else -1 for p in page.parents]
        for i, found in enumerate(features(page)):
            for f in found:
                if (k := vocabulary.get(f)) is not None:
                    node.append(at + i)
                    feature.append(k)
        at += len(page.parents)
    depth = np.array([d for p in pages for d in p.depths], dtype=np.int64)
    order = np.argsort(depth, kind="stable")
    by_depth = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    return Forest(np.array(parent, dtype=np.int64), depth, np.array([t is not None for p in pages for t in p.texts], dtype=bool), np.array(node, dtype=np.int64), np.array(feature, dtype=np.int64), by_depth)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(f: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all nodes, and of all edges (child, parent label, child label).

    own: log odds of main text by node. edge: log potentials [kind of child][parent label][child label], the kinds being element and text block.
    """
    n = len(own)
    kind = f.leaf.astype(int)
    below = own.copy()  # log odds of a node by all that hangs on it
    up = np.zeros(n)  # log odds message to the parent
    for nodes in f.by_depth[:0:-1]:
        e, b = edge[kind[nodes]], below[nodes]
        up[nodes] = _log_add(e[:, 1, 0], e[:, 1, 1] + b) - _log_add(e[:, 0, 0], e[:, 0, 1] + b)
        np.add.at(below, f.parent[nodes], up[nodes])
    belief = below.copy()
    cavity = np.zeros(n)  # log odds of the parent without this child
    for nodes in f.by_depth[1:]:
        e = edge[kind[nodes]]
        cavity[nodes] = belief[f.parent[nodes]] - up[nodes]
        c = cavity[nodes]
        belief[nodes] = below[nodes] + _log_add(e[:, 0, 1], e[:, 1, 1] + c) - _log_add(e[:, 0, 0], e[:, 1, 0] + c)
    joint = edge[kind] + cavity[:, None, None] * np.array([0, 1])[None, :, None] + below[:, None, None] * np.array([0, 1])[None, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return 1 / (1 + np.exp(-np.clip(belief, -50, 50))), joint / joint.sum(axis=(1, 2), keepdims=True)


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, pages: list[Page]) -> tuple[Forest, np.ndarray]:
        f = forest(pages, self.vocabulary)
        own = np.bincount(f.node, weights=self.weights[f.feature], minlength=len(f.parent))
        return f, sum_product(f, own, self.edge)[0]


def _labels(page: Page) -> np.ndarray:
    """A text block has the label of its nearest marked ancestor; an element that of most of its text."""
    marks, n = list(page.marks), len(page.parents)
    for i in range(n):
        if marks[i] < 0:
            marks[i] = marks[page.parents[i]] if page.parents[i] >= 0 else 0
    main, whole = np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        if page.texts[i] is not None:
            main[i], whole[i] = len(page.texts[i]) * marks[i], len(page.texts[i])
        if page.parents[i] >= 0:
            main[page.parents[i]] += main[i]
            whole[page.parents[i]] += whole[i]
    return np.where(whole > 0, 2 * main >= whole, np.array(marks) > 0).astype(int)


def train(sources: list[str], steps: int = 200, rate: float = 0.1, ridge: float = 0.003) -> Model:
    """Maximises the likelihood of the labels of all nodes of the pages, by Adam."""
    pages = [parse(s) for s in sources]
    label = np.concatenate([_labels(p) for p in pages])
    often = Counter(x for p in pages for x in {x for fs in features(p) for x in fs})
    vocabulary = {x: i for i, x in enumerate(sorted(x for x, n in often.items() if n > 1))}
    f = forest(pages, vocabulary)
    w = len(vocabulary)
    kind, child = f.leaf.astype(int), np.flatnonzero(f.parent >= 0)
    seen_edge = np.zeros((2, 2, 2))
    np.add.at(seen_edge, (kind[child], label[f.parent[child]], label[child]), 1)
    seen_own = np.bincount(f.feature, weights=label[f.node], minlength=w)
    x, m, v = np.zeros(w + 8), np.zeros(w + 8), np.zeros(w + 8)
    for t in range(1, steps + 1):
        own = np.bincount(f.node, weights=x[:w][f.feature], minlength=len(label))
        marginal, joint = sum_product(f, own, x[w:].reshape(2, 2, 2))
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind[child], joint[child])
        g = np.concatenate([np.bincount(f.feature, weights=marginal[f.node], minlength=w) - seen_own, (expected - seen_edge).ravel()]) / len(pages) + ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(vocabulary, x[:w], x[w:].reshape(2, 2, 2))


def chosen(page: Page, marginal: np.ndarray) -> list[str]:
    """The text blocks that are likelier main text than not. Where none is, but a block of ENOUGH words stands outside forms, some block of the page is held to be main: what is at least half as likely as the likeliest such block."""
    at = [i for i, t in enumerate(page.texts) if t is not None]
    if not any(marginal[i] > 0.5 for i in at):
        odds = marginal / (1 - marginal + 1e-12)
        large = [odds[i] for i in at if len(page.texts[i].split()) >= ENOUGH and page.tags[page.parents[i]] not in ASKS and 2 * page.link_chars[i] < len(page.texts[i])]
        best = max(large, default=np.inf)
        return [page.texts[i] for i in at if odds[i] >= best / 2]
    return [page.texts[i] for i in at if marginal[i] > 0.5]


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    _, marginal = model.marginals(pages)
    out, at = [], 0
    for page in pages:
        out.append("\n".join(chosen(page, marginal[at : at + len(page.parents)])))
        at += len(page.parents)
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled pages."""
    return train(list(labelled_pages()))


def extract(df: DataFrame, html_col: str, keep: list[str], model: Model | None = None, batch: int = 128) -> DataFrame:
    """A row for each page: the columns in keep, text and n_chars (its characters). A kept column that bears the name of a result is left out."""
    model = model or trained()  # as large as the labelled pages' vocabulary
    keep = [c for c in keep if c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = main_texts([x or "" for x in part.column(len(keep)).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, kinds + "text string, n_chars bigint")
