"""Main text of web pages: boosted trees over DOM elements, decoded along the tree.

Each block element of a page has features (subtree text density, attribute tokens, depth, sibling statistics and more,
see ``dom.FEATURES``). Gradient-boosted trees give each the log odds of main text. Decoding picks the labels of
highest joint probability, weighted by own text, under one rule: below a dropped element everything is
dropped. So no element contradicts its ancestors or descendants.

Training needs no labels by hand: the elements of at most ``sample`` pages (parameter) that mark
their article (article, main), drawn from all such pages, are labelled by it; navigation, headers, footers, asides, forms and the like
inside or outside are the other class. From the lines of each such page ``COPIES`` pages of other structure are made, with
other elements and class names, deeper nesting, and comments, notices and lists inside the article, and one whose main text
stands in the body itself, so that the trees weigh several signs and do not hang on one template.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined results: null or empty html gives an empty text; so does a page on which nothing is main text. Broken
markup never fails: open elements end with the page, stray end tags and lone ``<`` are ignored or text. Text outside
of head and body is text of the body, which need not be opened. Only script, style, title, textarea and iframe are no text. Rows are
extracted one by one, so repeated rows, nulls and other columns do not matter. Where no page marks its article, a built-in
example and the pages made from it are what is learned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .dom import AGAINST, AWAY, FOR, TOWARDS, Page
from .frames import bounded, column

SAMPLE = 400
COPIES = 5
#: Pages that hold a tag of ``dom.TOWARDS``.
MARKED = r"(?i)<(article|main)[\s/>]"
#: A page in a batch stands for its elements; this many are scored at once.
PAGES = 500

_EXAMPLE = (
    "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><article><h1>On rivers</h1>"
    "<p>A river is a body of water that runs, mostly, down to the sea; it carves its bed.</p><p>Its banks, its bends and its"
    " mouth change with the years, and so do its names.</p></article><footer>All rights kept.</footer></body></html>"
)


def weak_labels(page: Page) -> np.ndarray:
    """1 main, 0 not, -1 unknown, for each element of a page that marks its article; else all unknown."""
    n = len(page.tag)
    if not any(t in TOWARDS for t in page.tag):
        return np.full(n, -1)
    inside, out = [False] * n, [False] * n
    for i in range(n):
        p = page.parent[i]
        inside[i] = page.tag[i] in TOWARDS or i > 0 and inside[p]
        out[i] = page.tag[i] in AWAY or bool(page.attr[i] & AGAINST) or i > 0 and out[p]
    label = np.array([1 if a and not b else 0 for a, b in zip(inside, out, strict=True)])
    holds = [False] * n  # above an article: neither
    for i in range(n - 1, -1, -1):
        if (page.tag[i] in TOWARDS or holds[i]) and i:
            holds[page.parent[i]] = True
    label[[i for i in range(n) if holds[i] and not inside[i]]] = -1
    return label


class _Builder:
    """A made page, element by element, with its labels."""

    def __init__(self, lines: list[str], rng: random.Random) -> None:
        self.page, self.label, self.lines, self.rng = Page(""), [-1], lines, rng

    def add(self, tag: str, parent: int, label: int, attr=(), line: str | None = None, linked: bool = False) -> int:
        page, at = self.page, len(self.page.tag)
        page.tag.append(tag)
        page.attr.append(frozenset(attr))
        page.parent.append(parent)
        page.links.append(len(line) if line and linked else 0)
        page.marks.append(1 + linked)
        if line:
            page.lines.append((at, line))
        self.label.append(label)
        return at

    def wrapped(self, parent: int, label: int, most: int) -> int:
        for _ in range(self.rng.randint(0, most)):
            names = self.rng.sample(sorted(FOR), 1) if label == 1 and self.rng.random() < 0.4 else ()
            parent = self.add(self.rng.choice(["div", "section"]), parent, label, names)
        return parent

    def line(self, short: float) -> str:
        line = self.rng.choice(self.lines)
        return line[: self.rng.randint(4, 60)] if self.rng.random() < short else line

    def beside(self, parent: int) -> None:
        """Navigation, notices, comments and the like."""
        rng, plain = self.rng, self.rng.random() < 0.4
        tag = rng.choice(sorted(AWAY - {"head", "option"})) if plain else rng.choice(["div", "section", "ul", "p"])
        names = () if plain and rng.random() < 0.7 else rng.sample(sorted(AGAINST), rng.choice([1, 1, 2]))
        linked, short = rng.choice([0.0, 0.2, 0.9]), rng.choice([0.2, 0.9])
        top = self.add(tag, parent, 0, names, self.line(short) if tag == "p" or rng.random() < 0.3 else None)
        if tag != "p":
            top = self.wrapped(top, 0, 2)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                self.add(rng.choice(["p", "p", "li", "div"]), top, 0, (), self.line(short), rng.random() < linked)

    def main(self, parent: int) -> None:
        rng = self.rng
        tag = rng.choice(["article", "main", "div", "div", "section"])
        names = rng.sample(sorted(FOR), rng.choice([1, 2])) if tag not in TOWARDS or rng.random() < 0.3 else ()
        top = self.wrapped(self.add(tag, parent, 1, names), 1, 2)
        for k in range(rng.choice([1, 2, 5, 10])):
            if rng.random() < 0.15:
                self.beside(top)
            kind = rng.choice(["h1", "h2"]) if k == 0 or rng.random() < 0.1 else rng.choice(["p"] * 8 + ["li", "blockquote", "div", "td"])
            self.add(kind, top, 1, (), self.line(0.8 if kind[0] == "h" else 0.1), rng.random() < 0.03)
        if rng.random() < 0.4:
            self.beside(top)


def made_page(lines: list[str], rng: random.Random) -> tuple[Page, np.ndarray]:
    """A page of other structure around the same lines."""
    made = _Builder(lines, rng)
    body = made.wrapped(made.add("body", 0, -1), -1, 2)
    for k in range(rng.randint(0, 3) + 1 + rng.randint(0, 3)):
        made.main(body) if k == 2 else made.beside(body)
    if 1 not in made.label:
        made.main(body)
    return made.page, np.array(made.label)


def bare_page(lines: list[str], rng: random.Random) -> tuple[Page, np.ndarray]:
    """A page whose main text stands in the body itself, alone or between other things."""
    made = _Builder(lines, rng)
    body = made.add("body", 0, 1)
    for _ in range(rng.choice([0, 0, 1, 2])):
        made.beside(body)
    for _ in range(rng.choice([1, 1, 2, 5, 10])):
        made.page.lines.append((body, made.line(0.1)))
        made.page.marks[body] += rng.choice([0, 1, 3])
    for _ in range(rng.choice([0, 0, 1, 2])):
        made.beside(body)
    return made.page, np.array(made.label)


def examples(source: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page and of pages made from its lines."""
    rng = random.Random(seed)
    page = Page(source)
    label = weak_labels(page)
    lines = [line for i, line in page.lines if label[i] == 1]
    if not lines:
        return np.zeros((0, 0)), np.zeros(0)
    found = [(page, label), *(made_page(lines, rng) for _ in range(COPIES)), bare_page(lines, rng)]
    return (
        np.vstack([p.features()[y >= 0] for p, y in found]),
        np.concatenate([y[y >= 0] for _, y in found]),
    )


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Trees learned from at most ``sample`` pages; features are made by Spark, the fit has a fixed size."""
    html = column(pages, "html").cast("string")
    known = pages.select(html.alias("html"), F.xxhash64(column(pages, "page_id")).alias("key"))
    # Only these can teach anything; the sample is drawn from them, however few they are.
    marked = known.where(html.rlike(MARKED))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, key in zip(batch.column("html"), batch.column("key").to_pylist(), strict=True):
                x, y = examples(source.as_py(), key)
                if len(y):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(y)), pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(np.int32))],
                        ["key", "x", "y"],
                    )

    rows = bounded(marked, F.col("key"), sample).mapInArrow(made, "key long, x array<double>, y int").collect()
    if rows:
        x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
        order = np.lexsort((y, *x.T))
        x, y = x[order], y[order]
    if not rows or y.min() == y.max():
        x, y = examples(_EXAMPLE, 1)
    return trees.fit(x, y.astype(float))


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Kept elements: the best labels under which whatever is below a dropped element is dropped."""
    n = len(page.tag)
    weight = np.log1p(page.own_sizes()) + 0.5
    odds = np.clip(odds, -8, 8)
    keep = (-np.logaddexp(0, -odds) * weight).tolist()
    drop = (-np.logaddexp(0, odds) * weight).tolist()
    best = keep[:]
    for i in range(n - 1, 0, -1):
        # What passes through is free to hold dropped parts; a parent's own choice is made above it.
        best[page.parent[i]] += max(best[i], drop[i])
        drop[page.parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > drop[i]
    return kept


def extract(pages: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with text and the numbers of the kept elements and of all."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES):
                rows = batch.slice(low, PAGES)
                read = [Page(s or "") for s in rows.column("__html").to_pylist()]
                tables = [p.features() for p in read]
                odds = trees.log_odds(model, np.vstack(tables))
                at, found, kept_n = 0, [], []
                for page, table in zip(read, tables, strict=True):
                    kept = decode(page, odds[at : at + len(table)])
                    at += len(table)
                    found.append(" ".join(line for i, line in page.lines if kept[i]))
                    kept_n.append(sum(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in keep), pa.array(found, pa.string()), pa.array(kept_n, pa.int64()),
                        pa.array([len(t) for t in tables], pa.int64()),
                    ],
                    [*keep, "text", "n_kept", "n_elements"],
                )

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    chosen = pages.select(*[column(pages, c) for c in keep], column(pages, "html").cast("string").alias("__html"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return chosen.mapInArrow(texts, f"{schema}, text string, n_kept long, n_elements long")
