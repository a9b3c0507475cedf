"""Main text of web pages by a graphical model on the tree of their elements.

Every block element and every run of text is part of the article or not. Features of a
node weigh its own label, potentials between parent and child weigh the pair. Messages
passed from the leaves to the page and back give each run's exact marginal, and those of
one half and more are the text. Weights and potentials maximise the likelihood of
labelled pages; its gradient comes from the same messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm import dom, labelled_pages
from logwarden.llm.common import share

#: A feature takes part if so many nodes of the labelled pages have it.
MIN_NODES = 3
STEPS, RATE, SHRINK = 150, 0.15, 0.02
#: Characters of pages that are labelled together; a longer page is labelled alone.
BATCH_CHARS = 1 << 20
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kinds of a child, each with its own potential towards its parent.
TEXT, PARAGRAPH, STRUCTURE, DIVISION = range(4)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LENGTHS = np.array([15, 40, 100, 300, 1000])
_SHARES = np.array([0.02, 0.2, 0.5, 0.9])


def _names(attributes: str) -> set[str]:
    """Parts of class, id and role of a start tag, in lower case."""
    if "=" not in attributes:
        return set()
    found = dom.attributes(attributes)
    return {w.lower() for a in ("class", "id", "role") if a in found for w in _NAME.findall(found[a])}


def _kind(node: dom.Node) -> int:
    if not node.tag:
        return TEXT
    if node.tag in ("div", "section", "td"):
        return DIVISION
    return PARAGRAPH if node.tag in ("p", "li", "blockquote", "ul", "ol", "pre", "dd", "dt", "dl") or node.tag in HEADINGS else STRUCTURE


def features(nodes: list[dom.Node]) -> list[list[str]]:
    """Names of what is true of each node."""
    out = []
    for node in nodes:
        size = int(np.searchsorted(_LENGTHS, node.chars, side="right"))
        share = int(np.searchsorted(_SHARES, node.linked / node.chars if node.chars else 0.0, side="right"))
        kind = "text" if not node.tag else "block"
        names = [f"{kind} length {size}", f"{kind} links {share}"]
        if node.tag:
            names += [f"tag {node.tag}", f"paragraphs {min(node.paragraphs, 3)}", f"controls {min(node.controls, 2)}"]
            names += [f"name {n}" for n in _names(node.attributes)]
        else:
            names += [f"inside {nodes[node.parent].tag}", f"ends {node.text[-1] in '.!?'}", f"commas {min(node.text.count(','), 2)}"]
            if "©" in node.text:
                names.append("copyright sign")
        out.append(names)
    return out


class Forest:
    """Trees of several pages, level by level, and the features of their nodes."""

    def __init__(self, pages: list[list[dom.Node]], known: dict[str, int]):
        sizes = [len(p) for p in pages]
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        nodes = [n for p in pages for n in p]
        parent = np.array([n.parent for n in nodes], dtype=np.int64)
        self.count, self.parent = len(nodes), np.where(parent < 0, -1, parent + first)
        self.kind = np.array([_kind(n) for n in nodes], dtype=np.int64)
        depth = np.array([n.depth for n in nodes], dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        edges = np.flatnonzero(np.diff(depth[order], prepend=-1))
        self.levels = np.split(order, edges[1:])
        pairs = [(k, known[f]) for p, at in zip(pages, np.cumsum(sizes) - sizes) for k, names in enumerate(features(p), int(at)) for f in names if f in known]
        self.node, self.feature = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        # Many like children say little more than one: runs and paragraphs share one voice among siblings.
        voices, value = np.bincount(self.parent + 1, minlength=self.count + 1), np.ones(self.count)
        for level in self.levels[1:]:
            over = self.parent[level]
            shared = np.where(self.kind[over] <= PARAGRAPH, value[over], 1.0) / voices[over + 1]
            value[level] = np.where(self.kind[level] <= PARAGRAPH, shared, 1.0)
        self.value = value[self.node]

    def sums(self, of: np.ndarray, many: int) -> np.ndarray:
        """Sum of each feature over the nodes, weighed by ``of``."""
        return np.bincount(self.feature, weights=self.value * of[self.node], minlength=many)

    def marginals(self, weights: np.ndarray, potentials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(of each node [n, 2], of each pair of parent and child [n, 2, 2]); sum-product up and down the trees."""
        own = np.zeros((self.count, 2))
        own[:, 1] = np.bincount(self.node, weights=self.value * weights[self.feature], minlength=self.count)
        pair = potentials[self.kind]  # [node, its parent's label, its own]
        below, up = own.copy(), np.zeros((self.count, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp(pair[level, :, 0] + below[level, None, 0], pair[level, :, 1] + below[level, None, 1])
            np.add.at(below, self.parent[level], up[level])
        above = np.zeros((self.count, 2))
        both = np.zeros((self.count, 2, 2))
        for level in self.levels[1:]:
            rest = below[self.parent[level]] + above[self.parent[level]] - up[level]
            joint = rest[:, :, None] + pair[level]
            above[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[level] = joint + below[level, None, :]
        return _shares(below + above), _shares(both.reshape(-1, 4)).reshape(-1, 2, 2)


def _shares(log: np.ndarray) -> np.ndarray:
    out = np.exp(log - log.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def _log_shares(values: np.ndarray) -> np.ndarray:
    """Potentials [kind, parent's label, own label]; for each label of the parent they are log shares."""
    raw = values.reshape(4, 2, 2)
    return raw - np.logaddexp(raw[:, :, :1], raw[:, :, 1:])


def labels(nodes: list[dom.Node]) -> np.ndarray:
    """Labels of a labelled page: inside ``data-main`` and not inside ``data-other``."""
    out = np.zeros(len(nodes), dtype=np.int64)
    for k, node in enumerate(nodes):
        marks = node.attributes
        inside = out[node.parent] if node.parent >= 0 else 0
        out[k] = 0 if "data-other" in marks else 1 if "data-main" in marks else inside
    return out


class Model:
    """Feature weights and the potentials of each kind of child: a few thousand numbers."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, potentials: np.ndarray):
        self.known, self.weights, self.potentials = known, weights, potentials

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        trees = [dom.parse(p) for p in pages]
        share, _ = Forest(trees, self.known).marginals(self.weights, self.potentials)
        out, at = [], 0
        for nodes in trees:
            kept = share[at : at + len(nodes), 1] >= 0.5
            out.append("\n".join([n.text for n, k in zip(nodes, kept) if k and not n.tag]))
            at += len(nodes)
        return out


def fit(pages: Iterable[str] | None = None, steps: int = STEPS) -> Model:
    """Fit the model to labelled pages (by default the ``labelled_pages``, a fixed number of them).

    Gradient steps on the regularised likelihood, with step sizes by the history of each number.
    """
    trees = [dom.parse(p) for p in (labelled_pages.pages() if pages is None else pages)]
    seen: dict[str, int] = {}
    for tree in trees:
        for names in features(tree):
            for f in names:
                seen[f] = seen.get(f, 0) + 1
    known = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_NODES))}
    forest = Forest(trees, known)
    want = np.concatenate([labels(t) for t in trees])
    child = np.flatnonzero(forest.parent >= 0)
    seen_pairs = np.zeros((4, 2, 2))
    np.add.at(seen_pairs, (forest.kind[child], want[forest.parent[child]], want[child]), 1)
    found = forest.sums(want, len(known))
    values = np.zeros(len(known) + 16)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        potentials = _log_shares(values[len(known) :])
        share, both = forest.marginals(values[: len(known)], potentials)
        expected = forest.sums(share[:, 1], len(known))
        pairs = np.zeros((4, 2, 2))
        np.add.at(pairs, forest.kind[child], both[child])
        pull = seen_pairs - pairs
        pull -= np.exp(potentials) * pull.sum(2, keepdims=True)
        slope = np.concatenate([found - expected, pull.ravel()]) - SHRINK * values
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        values = values + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(known, values[: len(known)], _log_shares(values[len(known) :]))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text and n_chars.

    Text is the article's, without menus, headers, footers, sidebars, notices, adverts, forms and
    comments: character references decoded, white space of a block as one space, blocks in
    page order joined by line feeds. A null page counts as empty; an empty page, and one
    without an article, has the empty text. Any text is read as a page, however broken, long
    or deep. Repeated rows and null ids stay; other columns are not read.
    """
    fitted = fit() if model is None else model
    shared = share(pages.sparkSession, fitted)

    def runs(column: pa.Array):
        run, held = [], 0
        for x in column:
            page = x.as_py() or ""
            if run and held + len(page) > BATCH_CHARS:
                yield run
                run, held = [], 0
            run.append(page)
            held += len(page)
        if run:
            yield run

    def work(batches):
        for batch in batches:
            at = 0
            for run in runs(batch.column(2)):
                texts = shared.value.texts(run)
                columns = [batch.column(k).slice(at, len(run)) for k in (0, 1)]
                columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                at += len(run)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(work, "id long, url string, text string, n_chars long")
