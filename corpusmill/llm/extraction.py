"""Main-text extraction from HTML: boosted trees over DOM nodes, decoded hierarchically.

Every element is a node with features: sizes and densities of its subtree (text,
tags, links, stops), its own text, depth, attribute tokens and tag as hashed
indicators, and how it compares to its siblings. Boosted trees give each node a
log-odds that its subtree is main text. Decoding takes the most probable labelling in
which every descendant of a chosen node is chosen too: a sum over the tree, from the
leaves up, and one pass down. So no ancestor and descendant contradict each other.

Labels
    Distant ones: pages that mark their text (``article`` or ``main``) label their own
    nodes. The tags that tell (article, main, nav, aside, header, footer) are hidden
    from the features, so that the model also serves pages without them. The forest is
    fitted on the driver on at most ``sample_pages`` labelled pages of at most
    ``SAMPLE_CHARS`` characters, chosen by a hash; all pages are extracted.

Plan
    Extraction is a map over the pages with the forest broadcast; nothing shuffles.
    A subtree is a range of the document's order, so that sums over subtrees are
    differences of running sums; decoding is one pass up and one down. All of it is
    linear in a page, however long or deeply nested.

Defined results
    (page_id, text, n_nodes, n_kept). Blocks of text are parted by newlines. null or
    empty HTML: empty text, no nodes. Text without tags: one node. No labelled page at
    all: every node has even odds, and nothing is kept. Null id: a row with null.
    Repeated rows: each has a row. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import boosting, htmltree
from corpusmill.session import Shared

SAMPLE_PAGES, SAMPLE_CHARS = 400, 1 << 18
HIDDEN = frozenset("article main nav aside header footer".split())
TOKENS, TAGS = 24, 16
CHUNK_CHARS = 8 << 20


class Nodes:
    """The nodes of many trees as arrays; a child always comes after its parent."""

    def __init__(self, trees: list[htmltree.Tree]):
        counts = np.array([len(t.tags) for t in trees], np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        shift = np.repeat(self.first[:-1], counts)
        parent = np.array([p for t in trees for p in t.parents], np.int64)
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.depth = np.array([d for t in trees for d in t.depths], np.int64)
        self.tags = [g for t in trees for g in t.tags]
        self.trees = trees
        size = [1] * len(self.tags)
        for i, p in zip(range(len(size) - 1, -1, -1), reversed(self.parent.tolist())):
            if p >= 0:
                size[p] += size[i]
        self.end = np.arange(len(size)) + np.array(size, np.int64)  # a subtree is a range of the document's order

    def up(self, value: np.ndarray) -> np.ndarray:
        """Sums of whole numbers over subtrees."""
        total = np.concatenate([[0.0], np.cumsum(value)])
        return total[self.end] - total[:-1]

    def down(self, value: np.ndarray) -> np.ndarray:
        """Whether the node or an ancestor has the value."""
        out = value.tolist()
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0 and out[p]:
                out[i] = True
        return np.array(out, bool)

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own = np.zeros((4, n))  # characters, words, stops, capitals
        at = np.array([self.first[i] + e for i, t in enumerate(self.trees) for e, _ in t.texts], np.int64)
        texts = [s for t in self.trees for _, s in t.texts]
        measures = ([len(s) for s in texts], [s.count(" ") + 1 for s in texts], [s.count(".") + s.count(",") for s in texts], [s[:1].isupper() for s in texts])
        for row, m in zip(own, measures):
            np.add.at(row, at, np.array(m, np.float64))
        names, which = np.unique(np.array(self.tags, object).astype(str), return_inverse=True) if n else (np.zeros(0, str), np.zeros(0, np.int64))
        is_link = np.array([t == "a" for t in names], bool)[which] if n else np.zeros(0, bool)
        linked = self.down(is_link)
        chars, words, stops, caps = (self.up(x) for x in own)
        link_chars, tags, links = self.up(np.where(linked, own[0], 0)), self.up(np.ones(n)), self.up(is_link)
        has = self.parent >= 0
        kids = np.bincount(self.parent[has], minlength=n)[:n].astype(np.float64)
        order = np.argsort(np.where(has, self.parent, n + np.arange(n)), kind="stable")
        key = np.where(has, self.parent, n + np.arange(n))[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        place = np.zeros(n)
        place[order] = np.arange(n) - np.repeat(start, size)
        family = np.zeros(n)
        family[order] = np.repeat(size, size)
        among = np.zeros(n)
        if n:
            among[order] = np.repeat(np.add.reduceat(chars[order], start), size)
        up_chars = np.where(has, chars[np.maximum(self.parent, 0)], chars)
        per = lambda a, b: a / np.maximum(b, 1)
        dense = [
            np.log1p(chars), np.log1p(own[0]), np.log1p(tags), per(chars, tags), per(link_chars, chars), per(links, tags), per(words, tags), per(chars, words), per(stops, words),
            per(caps, tags), self.depth, kids, place, per(place, family - 1), family, per(chars, among), per(among, family), per(chars, up_chars), per(own[0], chars),
        ]
        hashed = np.zeros((n, TOKENS + 2 * TAGS))
        code = np.array([zlib.crc32(t.encode()) % TAGS if t not in HIDDEN else -1 for t in names], np.int64)[which] if n else np.zeros(0, np.int64)
        seen = np.flatnonzero(code >= 0)
        hashed[seen, TOKENS + code[seen]] = 1
        above = np.where(has, code[np.maximum(self.parent, 0)], -1)
        seen = np.flatnonzero(above >= 0)
        hashed[seen, TOKENS + TAGS + above[seen]] = 1
        i = 0
        for t in self.trees:
            for token in t.tokens:
                for x in token:
                    hashed[i, zlib.crc32(x.encode()) % TOKENS] = 1
                i += 1
        return np.hstack([np.stack(dense, 1) if n else np.zeros((0, len(dense))), hashed])

    def labels(self) -> np.ndarray:
        """Whether each node is within an ``article`` or ``main``."""
        return self.down(np.array([t in ("article", "main") for t in self.tags], bool))

    def decode(self, logit: np.ndarray) -> np.ndarray:
        """The most probable choice in which a chosen node's descendants are all chosen."""
        whole = logit.tolist()  # the node and all below it are chosen
        best = [0.0] * len(whole)  # the node is not chosen: the sum of its children's best
        for i, p in zip(range(len(whole) - 1, -1, -1), reversed(self.parent.tolist())):
            if p >= 0:
                whole[p] += whole[i]
                best[p] += max(whole[i], best[i])
        return self.down(np.array([w > b for w, b in zip(whole, best)], bool))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> boosting.Forest:
    """A forest of at most ``sample_pages`` pages of at most ``SAMPLE_CHARS`` characters that mark their main text."""
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]") & (F.length(html_col) <= SAMPLE_CHARS))
    marked = marked.select(F.col(html_col).alias("html_"), F.xxhash64(id_col, html_col).alias("h_"))
    # hashes are ranked without their pages
    keys = [r[0] for r in marked.select("h_").distinct().orderBy("h_").limit(sample_pages).collect()]
    found = {r["h_"]: r["html_"] for r in marked.where(F.col("h_").isin(keys)).dropDuplicates(["h_"]).collect()}
    sample = [found[k] for k in keys]
    nodes = Nodes([htmltree.parse(x) for x in sample])
    return boosting.fit(nodes.features(), nodes.labels().astype(np.float64))


def render(tree: htmltree.Tree, chosen: np.ndarray) -> str:
    """The texts of chosen nodes; a new block, or text left out between, starts a line."""
    lines: list[str] = []
    last = None
    block: list[int] = []  # the nearest block of each element; parents come first
    for i, (tag, parent) in enumerate(zip(tree.tags, tree.parents)):
        block.append(i if parent < 0 or tag in htmltree.BLOCK else block[parent])
    for element, text in tree.texts:
        if not chosen[element]:
            last = None
        elif (b := block[element]) == last:
            lines[-1] += text
        else:
            lines.append(text)
            last = b
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def extract_pages(sources: list[str | None], forest: boosting.Forest) -> Iterator[tuple[str, int, int]]:
    """(text, nodes, kept nodes) of each page; pages are taken in groups of bounded size."""
    at = 0
    while at < len(sources):
        end, chars = at, 0
        while end < len(sources) and (end == at or chars + len(sources[end] or "") <= CHUNK_CHARS):
            chars += len(sources[end] or "")
            end += 1
        nodes = Nodes([htmltree.parse(x or "") for x in sources[at:end]])
        chosen = nodes.decode(forest.logit(nodes.features()))
        for i, tree in enumerate(nodes.trees):
            own = chosen[nodes.first[i] : nodes.first[i + 1]]
            yield render(tree, own), len(own), int(own.sum())
        at = end


def extract(pages: DataFrame, forest: boosting.Forest, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    shared = Shared(pages.sparkSession, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(extract_pages(batch.column(1).to_pylist(), shared.value))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", "text", "n_nodes", "n_kept"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html_"))
    return rows.mapInArrow(run, "page_id bigint, text string, n_nodes bigint, n_kept bigint")
