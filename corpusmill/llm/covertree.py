"""Exact top-k search: each query's k nearest other vectors, by a dual-tree search.

Queries and data are indexed together in one cover tree. The children of a node are a
net of its vectors, chosen furthest first: their centres are further apart than any
vector below the node is from its nearest centre. A node knows its covering radius,
the largest distance from its centre to a vector below it. A pair of nodes (queries Q,
data R) is pruned when

    distance(centre Q, centre R) - radius Q - radius R > worst kth distance in Q.

Plan
1. The upper levels are the tree of a sample of at most ``SAMPLE_ROWS`` vectors, which
   only decides which vectors go together. Every vector descends it (a map with the
   tree broadcast) to one of its leaves, a cell. A cell that the sample shows to be large
   is salted, so that a part has about ``cell_rows`` vectors however many a cell gets.
   One shuffle brings each part together; its radius is measured there, and its queries
   get a first bound by searching it.
2. For each group of queries (cells that are near in the tree) its nodes descend against
   the data's, with radii from the bottom up, and pruned pairs end there. Parts of the
   cells that are left go once to the group, the nearest first.
3. In the group each part's own tree descends against the trees of the queries; pairs
   of leaves are matrix products. Each query stands in one group, which holds its k
   nearest: nothing is merged afterwards.
Exact: sums that decide are measured by differences in double precision. Of vectors
that are equal only the k + 1 smallest ids can be anyone's neighbours (all k are
reached without the query itself), so others are queries only.

Data with no structure prunes nothing and costs the full product of queries and data,
as any exact search does.

Defined results
    (query_id, neighbor_id, rank, distance), rank from 1, ties by id. A vector is
    never its own neighbour, nor is another vector of the same id. An id counts once,
    with its vector that is nearest; an id with several vectors asks with all of them.
    With fewer than k others all are returned; a table of one vector gives no rows.
    Null ids and vectors, other dimensions and elements not finite: left out, see
    ``vectors.clean``. Repeated rows count once. Ids are integers, or what casts to
    bigint. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import numtext as nt
from corpusmill.llm import vectors as vs
from corpusmill.session import Shared, cut

K, CELL_ROWS, LEAF, FANOUT = 10, 2048, 256, 8
SAMPLE_ROWS, SAMPLE_LEAF, GROUP_ROWS = 65536, 32, 32768


@dataclass
class Node:
    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)


def net(vecs: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """The first ``most`` centres, always the vector furthest from those before, and each vector's nearest."""
    chosen, near, whose = [0], vs.squares(vecs[:1], vecs)[0], np.zeros(len(vecs), np.int64)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        d = vs.squares(vecs[chosen[-1:]], vecs)[0]
        closer = d < near
        near[closer], whose[closer] = d[closer], len(chosen) - 1
        near[chosen[-1]] = 0
    return chosen, whose


def build(vecs: np.ndarray, rows: np.ndarray | None = None, center: np.ndarray | None = None, leaf: int | None = None) -> Node:
    """The cover tree of ``vecs[rows]``, double precision. Only few or equal vectors are a leaf."""
    rows = np.arange(len(vecs)) if rows is None else rows
    own = vecs[rows]
    center = own[0] if center is None else center
    radius = float(np.sqrt(vs.exact(own, np.broadcast_to(center, own.shape)).max())) if len(rows) else 0.0
    node = Node(center, radius, rows)
    if len(rows) > (LEAF if leaf is None else leaf) and radius > 0:
        chosen, whose = net(own, FANOUT)
        if len(chosen) > 1:
            node.children = [build(vecs, rows[whose == i], own[c], leaf) for i, c in enumerate(chosen)]
    return node


def search(queries: Node, data: Node, best: vs.Best, ids: np.ndarray, vecs: np.ndarray) -> None:
    """Dual-tree descent: nearer data first, so that bounds tighten early."""
    gap = float(np.sqrt(np.square(queries.center - data.center).sum())) - queries.radius - data.radius
    if gap > 0 and gap * gap > best.worst[queries.rows].max() * (1 + 1e-9) + 1e-9:
        return
    if data.children and (not queries.children or data.radius >= queries.radius):
        centers = np.array([c.center for c in data.children])
        for i in np.argsort(vs.squares(queries.center[None], centers)[0], kind="stable"):
            search(queries, data.children[i], best, ids, vecs)
    elif queries.children:
        for child in queries.children:
            search(child, data, best, ids, vecs)
    else:
        best.offer(queries.rows, ids[data.rows], vecs[data.rows])


@dataclass
class Upper:
    """The upper levels as arrays; a cell is a leaf, and its number is its place in ``leaves``."""

    centers: np.ndarray
    children: list[list[int]]
    leaves: np.ndarray
    salts: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: by the nearest child, level by level."""
        at, number = np.zeros(len(x), np.int64), np.full(len(self.children), -1)
        number[self.leaves] = np.arange(len(self.leaves))
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            kids = self.children[node]
            if not kids:
                at[rows] = number[node]
                continue
            which = np.concatenate([vs.squares(x[rows[a : a + 4096]], self.centers[kids]).argmin(1) for a in range(0, len(rows), 4096)]) if len(rows) else rows
            waiting += [(kid, rows[which == i]) for i, kid in enumerate(kids)]
        return at

    def bottom_up(self, radius: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all nodes, from their cells': covering radii, and worst kth distances (-inf without queries)."""
        r, b = np.full(len(self.children), -np.inf), np.full(len(self.children), -np.inf)
        r[self.leaves], b[self.leaves] = radius, bound
        for node in range(len(self.children) - 1, -1, -1):  # children come after their parent
            if kids := self.children[node]:
                apart = np.sqrt(vs.exact(self.centers[kids], np.broadcast_to(self.centers[node], (len(kids), self.centers.shape[1]))))
                r[node], b[node] = (apart + r[kids]).max(), b[kids].max()
        return r, b

    def unpruned(self, radius: np.ndarray, bound: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cells of data, and how far their centres are, that the descent of pairs of nodes leaves for the queries of the cells ``mine``.

        Also the number of pairs of nodes that were looked at.
        """
        own = np.full(len(self.leaves), -np.inf)
        own[mine] = bound[mine]
        r, b = self.bottom_up(radius, own)
        inner = np.array([bool(c) for c in self.children])
        count = np.array([len(c) for c in self.children])
        first = np.cumsum(count) - count
        kids = np.array([k for c in self.children for k in c], np.int64)
        far = np.full(len(self.children), np.inf)
        q, d, looked = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        while len(q):
            nq, nd = [], []
            for a in range(0, len(q), 1 << 15):
                x, y = q[a : a + (1 << 15)], d[a : a + (1 << 15)]
                live = np.isfinite(r[y]) & (b[x] > -np.inf)
                x, y = x[live], y[live]
                looked += len(x)
                apart = np.sqrt(vs.exact(self.centers[x], self.centers[y]))
                live = apart - r[x] - r[y] <= b[x] * (1 + 1e-9) + 1e-6
                x, y, apart = x[live], y[live], apart[live]
                done = ~inner[x] & ~inner[y]
                np.minimum.at(far, y[done], apart[done])
                x, y = x[~done], y[~done]
                split = inner[y] & (~inner[x] | (r[y] >= r[x]))
                for part, grown, kept, grow, keep in ((split, y, x, nd, nq), (~split, x, y, nq, nd)):
                    g, k = grown[part], kept[part]
                    n = count[g]
                    grow.append(kids[np.repeat(first[g], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
                    keep.append(np.repeat(k, n))
            q, d = np.concatenate(nq), np.concatenate(nd)
        cells = np.flatnonzero(np.isfinite(far[self.leaves]))
        return cells, far[self.leaves][cells], looked


def upper(rows: DataFrame, dim: int, n: int, cell_rows: int) -> Upper:
    """The tree of a sample; ``n`` rows in all."""
    cells = max(1, n // cell_rows)
    want = min(SAMPLE_ROWS, SAMPLE_LEAF * cells)
    share = min(1.0, 1.2 * want / max(n, 1))
    h = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))
    table = rows.where(h < int(share * (1 << 30)) + 1).select("id", "vec").limit(2 * want).toArrow().sort_by("id")
    sample = vs.matrix(table["vec"].combine_chunks(), dim).astype(np.float64)
    sample = sample if len(sample) else np.zeros((1, dim))
    centers, children, leaves, salts = [], [], [], []
    waiting = [build(sample, leaf=SAMPLE_LEAF)]
    at = 0
    while at < len(waiting):  # breadth first: children come after their parent
        node = waiting[at]
        centers.append(node.center)
        children.append([len(waiting) + i for i in range(len(node.children))])
        if not node.children:
            leaves.append(at)
            salts.append(max(1, round(len(node.rows) / len(sample) * n / (2 * cell_rows))))
        waiting += node.children
        at += 1
    # cells in the order of the tree: those that are near have near numbers
    order, stack = [], [0]
    number = {leaf: i for i, leaf in enumerate(leaves)}
    while stack:
        node = stack.pop()
        stack += reversed(children[node])
        if not children[node]:
            order.append(number[node])
    return Upper(np.array(centers), children, np.array(leaves)[order], np.array(salts)[order])


def _pack(ids: np.ndarray, vecs: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype("<i8").tobytes(), vecs.astype("<f4").tobytes()


def _unpack(ids: bytes, vecs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8").astype(np.int64), np.frombuffer(vecs, "<f4").reshape(-1, dim).astype(np.float64)


def top_k(rows: DataFrame, k: int = K, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``queries``: which rows ask, a condition on the columns of ``rows``; all where it is not given."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, dim = vs.tagged(rows, k, queries, id_col, vec_col)
    own = cut(own)
    tree = upper(own, dim, own.count(), cell_rows)
    shared = Shared(spark, tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cells(vs.matrix(batch.column(1), dim).astype(np.float64))
            salt = nt.mix(nt.as_word(batch.column(0).to_numpy())) % shared.value.salts[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), *batch.columns], names=["cell", "salt", "id", "vec", "asks"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, salt), ids, vecs, asks in _parts(batches, dim):
            center = shared.value.centers[shared.value.leaves[cell]]
            radius = float(np.sqrt(vs.exact(vecs, np.broadcast_to(center, vecs.shape)).max()))
            best = vs.Best(ids[asks], vecs[asks], k)
            if asks.any() and not asks.all():
                data, own_ids = build(vecs[~asks]), ids[~asks]
                search(build(vecs[asks]), data, best, own_ids, vecs[~asks])
            bound = float(np.sqrt(best.worst.max())) if asks.any() else -1.0
            values = (cell, salt, *_pack(ids[~asks], vecs[~asks]), *_pack(ids[asks], vecs[asks]), best.worst.astype("<f8").tobytes(), radius, bound)
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["cell", "salt", "ids", "vecs", "qids", "qvecs", "worst", "radius", "bound"])

    cells = own.mapInArrow(assign, "cell int, salt int, id bigint, vec array<float>, asks boolean")
    cells = cells.repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", "id")
    cells = cut(cells.mapInArrow(bounded, "cell int, salt int, ids binary, vecs binary, qids binary, qvecs binary, worst binary, radius double, bound double"))
    # the cells: at most as many as the sample has leaves, whatever the table's size
    seen = cells.groupBy("cell").agg(F.max("radius").alias("radius"), F.max("bound").alias("bound"), F.sum(F.length("qids") / 8).alias("asking")).toArrow()
    radius, bound, asking = (np.full(len(tree.leaves), x) for x in (-np.inf, -np.inf, 0.0))
    at = seen["cell"].to_numpy()
    radius[at], asking[at] = seen["radius"].to_numpy(), seen["asking"].to_numpy()
    bound[at] = np.where(asking[at] > 0, seen["bound"].to_numpy(), -np.inf)
    total = max(1.0, asking.sum())
    # groups of about as many queries each; a cell with many has several, to which its parts go
    groups = int(max(1, min(total, max(parts, total // GROUP_ROWS))))
    ends = np.cumsum(asking)
    first = np.minimum((ends - asking) * groups // total, groups - 1).astype(np.int32)
    last = np.minimum(np.maximum(np.ceil(ends * groups / total) - 1, first), first + tree.salts - 1).astype(np.int32)
    levels = Shared(spark, (tree, radius, bound, first, last))

    def unpruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, radius, bound, first, last = levels.value
        for batch in batches:
            for g in batch.column(0).to_pylist():
                cell, far, _ = t.unpruned(radius, bound, np.flatnonzero((first <= g) & (g <= last)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.full(len(cell), g, np.int32)), pa.array(far)], names=["cell", "grp", "far"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, _, _, first, last = levels.value
            cell, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            g = first[cell] + salt * (last - first + 1)[cell] // t.salts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), *batch.columns[2:]], names=["grp", "ids", "vecs", "worst"])

    wanted = spark.range(groups).mapInArrow(unpruned, "cell int, grp int, far double")
    data = cells.where(F.length("ids") > 0).select("cell", "ids", "vecs").join(wanted, "cell")
    asked = cells.where(F.length("qids") > 0).select("cell", "salt", "qids", "qvecs", "worst").mapInArrow(grouped, "grp int, ids binary, vecs binary, worst binary")
    sent = asked.withColumn("far", F.lit(-1.0)).select("grp", "far", "ids", "vecs", "worst").union(data.select("grp", "far", "ids", "vecs", F.lit(None).cast("binary")))
    sent = sent.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "far", F.length("ids"), "ids").select("ids", "vecs", "worst")

    def dual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best: vs.Best | None = None
        trees: list[Node] = []
        for batch in batches:
            for i, v, worst in zip(*(batch.column(j).to_pylist() for j in range(3))):
                ids, vecs = _unpack(i, v, dim)
                if worst is not None:  # the group's queries come first
                    held.append((ids, vecs, np.frombuffer(worst, "<f8")))
                    continue
                if best is None:
                    best, trees = _group(held, k)
                tree = build(vecs)
                for own_tree in trees:
                    search(own_tree, tree, best, ids, vecs)
        if best is not None:
            yield best.batch()

    return vs.ranked(sent.mapInArrow(dual, vs.PAIRS), k)


def _group(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[vs.Best, list[Node]]:
    """A group's queries with the bounds that their own parts gave, and a tree of each part's."""
    ids, vecs, worst = (np.concatenate([x[i] for x in held]) for i in range(3))
    best, trees, at = vs.Best(ids, vecs, k), [], 0
    best.worst = worst.astype(np.float64)
    for own, _, _ in held:
        trees.append(build(vecs, np.arange(at, at + len(own))))
        at += len(own)
    return best, trees


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """Whole parts of cells of batches that are sorted by cell and salt."""
    key, held = (-1, -1), []
    for batch in batches:
        of = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        own, x, asks = batch.column(2).to_numpy(), vs.matrix(batch.column(3), dim), batch.column(4).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]).any(1)])) if len(of) else []
        for a, b in zip(edge, [*edge[1:], len(of)]):
            if tuple(of[a]) != key and held:
                yield key, *_joined(held)
                held = []
            key = (int(of[a][0]), int(of[a][1]))
            held.append((own[a:b], x[a:b].astype(np.float64), asks[a:b]))
    if held:
        yield key, *_joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([h[i] for h in held]) for i in range(3))
