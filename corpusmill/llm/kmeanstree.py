"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Plan
1. The tree is fitted on a bounded sample of ``SAMPLE_ROWS`` vectors: a node is split
   into ``branching`` children by k-means until its share of the table would fit a leaf.
   It has at most as many leaves as the sample can tell apart (``SAMPLE_LEAF`` rows
   each), which bounds its broadcast. Every row of the table is indexed: one map sends it
   down the tree, one shuffle brings leaves together, in blocks of ``BLOCK`` rows. A leaf
   that the sample shows to be large is salted, so that no task gets all of it. Of equal
   vectors only the k + 1 smallest ids are data, as in the exact search.
2. A query walks the tree with a priority queue over node centroids: the nearest
   waiting node is taken, an inner node puts its children in, a leaf is visited. Of two
   leaves the queue gives the one first whose path has the smaller largest distance below
   the node where the paths part, so that the order is a sort by the largest distance on
   the path, and on the path below each node; it is computed for many queries at once.
3. How many leaves to visit is calibrated: the true neighbours of up to
   ``calibration`` queries (an exact scan of all rows) are looked up in their leaf
   orders, and the visits widen until the recall, less two standard errors, reaches
   ``recall``. If it never does, all leaves are visited, and the search is exact.
4. Queries stay with the others of their part of the tree, as a group; these visit
   much the same leaves. Each leaf goes once to every group that visits it, and is a
   matrix product with the group's queries that do. A group holds its k nearest:
   nothing is merged afterwards, and no query is sent twice. What a query visits is one
   bit a leaf.

Defined results
    (query_id, neighbor_id, rank, distance) as in the exact search: ties by id, never
    oneself, an id counts once, no row for null or unfit vectors, repeated rows once,
    an empty table gives no rows. Distances are exact; only a neighbour may be missed.
    Ids are integers, or what casts to bigint. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import numtext as nt
from corpusmill.llm import vectors as vs
from corpusmill.session import Shared, cut

K, BRANCHING, LEAF_ROWS, ROUNDS = 10, 16, 256, 4
CALIBRATION, RECALL, SAMPLE_ROWS, SAMPLE_LEAF, BLOCK, SALT_ROWS, GROUP_ROWS = 256, 0.95, 65536, 8, 1024, 16384, 32768


@dataclass
class Tree:
    """Centroids of all nodes; node 0 is the root. A leaf has no children."""

    centroids: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    #: Rows of the table in each node, as far as the sample tells.
    rows: list[float] = field(default_factory=list)

    @property
    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row by nearest children from the root."""
        at, waiting = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            which = np.concatenate([vs.squares(x[rows[a : a + 4096]], self.centroids[kids]).argmin(1) for a in range(0, len(rows), 4096)])
            waiting += [(kid, rows[which == i]) for i, kid in enumerate(kids)]
        return at

    def visits(self, x: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Per query the first ``most`` leaves, best bin first."""
        leaves = np.array(self.leaves)
        up = np.zeros(len(self.children), np.int64)
        for node, kids in enumerate(self.children):
            up[kids] = node
        paths = []  # from below the root down; a leaf that is higher than others repeats itself
        for leaf in leaves.tolist():
            path = [leaf]
            while up[path[-1]] > 0:
                path.append(int(up[path[-1]]))
            paths.append(path[::-1])
        deep = max(map(len, paths))
        levels = np.array([path + path[-1:] * (deep - len(path)) for path in paths]).T
        for a in range(0, len(x), 64):
            d = vs.squares(x[a : a + 64], self.centroids)
            keys = [d[:, levels[-1]]]
            for nodes in levels[-2::-1]:
                keys.append(np.maximum(d[:, nodes], keys[-1]))
            for row in range(len(d)):
                yield leaves[np.lexsort([k[row] for k in keys])[:most]]

    def queued(self, x: np.ndarray) -> list[int]:
        """All leaves in one query's order, by the queue itself: what ``visits`` computes at once."""
        d = vs.squares(x[None], self.centroids)[0].tolist()
        heap, out = [(0.0, 0)], []
        while heap:
            _, node = heapq.heappop(heap)
            for kid in self.children[node]:
                heapq.heappush(heap, (d[kid], kid))
            if not self.children[node]:
                out.append(node)
        return out


def _spread(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """First guesses by k-means++; fewer than k if there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    near = vs.squares(x[chosen], x)[0]
    while len(chosen) < k and near.max() > 1e-12:
        chosen.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, vs.squares(x[chosen[-1:]], x)[0])
    return x[chosen]


def _split(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means: the centroids that have rows, and each row's."""
    guess = _spread(x, k, seed)
    for left in range(rounds, -1, -1):
        which = np.concatenate([vs.squares(x[a : a + 4096], guess).argmin(1) for a in range(0, len(x), 4096)])
        name, which = np.unique(which, return_inverse=True)
        guess = guess[name]
        if left:
            order = np.argsort(which, kind="stable")
            count = np.bincount(which)
            guess = np.add.reduceat(x[order], np.cumsum(count) - count) / count[:, None]
    return guess, which


def grow(own: DataFrame, dim: int, n: int, branching: int, leaf_rows: int, rounds: int) -> Tree:
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1))
    keep = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    table = own.where(keep).select("id", "vec").limit(SAMPLE_ROWS).toArrow().sort_by("id")
    sample = vs.matrix(table["vec"].combine_chunks(), dim).astype(np.float64)
    scale = n / max(len(sample), 1)
    tree = Tree(np.zeros((1, max(dim, 1))), [[]], [float(n)])
    waiting = [(0, np.arange(len(sample)))]
    while waiting:
        node, rows = waiting.pop(0)
        if len(rows) * scale <= leaf_rows or len(rows) <= SAMPLE_LEAF:
            continue
        want = int(min(branching, max(2, -(-len(rows) * scale // leaf_rows))))
        centers, which = _split(sample[rows], want, rounds, node)
        if len(centers) > 1:
            first = len(tree.children)
            tree.centroids = np.vstack([tree.centroids, centers])
            tree.children += [[] for _ in centers]
            tree.rows += (np.bincount(which, minlength=len(centers)) * scale).tolist()
            tree.children[node] = list(range(first, first + len(centers)))
            waiting += [(first + i, rows[which == i]) for i in range(len(centers))]
    return tree


def calibrated(own: DataFrame, tree: Tree, dim: int, k: int, calibration: int, recall: float) -> int:
    """Leaf visits at which the recall of a sample of queries reaches ``recall``."""
    spark, leaves = own.sparkSession, len(tree.leaves)
    # the sample's bound is ``calibration``; its true neighbours come from all rows
    asked = own.where("asks").orderBy(F.xxhash64("id", "vec"), "id").select("id", "vec").limit(calibration).toArrow()
    if not len(asked) or leaves == 1:
        return leaves
    ids, x = asked["id"].to_numpy(), vs.matrix(asked["vec"].combine_chunks(), dim).astype(np.float64)
    shared = Shared(spark, (ids, x, tree))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, v, t = shared.value
        best, leaf_of = vs.Best(q, v, k), {}
        for batch in batches:
            own_ids, y = batch.column(0).to_numpy(), vs.matrix(batch.column(1), dim).astype(np.float64)
            best.offer(np.arange(len(q)), own_ids, y)
            held = np.isin(own_ids, best.other)
            leaf_of |= dict(zip(own_ids[held].tolist(), t.descend(y[held]).tolist()))
        leaf = pa.array([leaf_of[n] for n in best.other.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(best.row), pa.array(best.other), pa.array(best.dist), leaf], names=["q", "n", "d", "leaf"])

    found = own.where("not asks").mapInArrow(truth, "q bigint, n bigint, d double, leaf bigint")
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "n", "leaf"))), 1, k)
    rows = found.groupBy("q").agg(near.alias("near")).select("q", F.col("near.leaf").alias("leaf")).collect()
    rank = [{int(leaf): i for i, leaf in enumerate(o)} for o in tree.visits(x, leaves)]
    needed = [np.array([rank[q][leaf] for leaf in near]) for q, near in rows]
    visits = 1
    while visits < leaves:
        got = np.array([(r < visits).mean() for r in needed]) if needed else np.ones(1)
        if got.mean() - 2 * got.std() / np.sqrt(len(got)) >= recall:
            break
        visits += 1
    return visits


def neighbors(
    rows: DataFrame, k: int = K, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", branching: int = BRANCHING,
    leaf_rows: int = LEAF_ROWS, rounds: int = ROUNDS, calibration: int = CALIBRATION, recall: float = RECALL,
) -> DataFrame:
    """``queries``: which rows ask, a condition on the columns of ``rows``; all where it is not given."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, dim = vs.tagged(rows, k, queries, id_col, vec_col)
    own = cut(own)
    n, asking = own.agg(F.count("*"), F.coalesce(F.count_if("asks"), F.lit(0))).first()
    tree = grow(own, dim, n, branching, leaf_rows, rounds)
    visits = calibrated(own, tree, dim, k, calibration, recall)
    groups = int(max(1, min(asking, max(parts, asking // GROUP_ROWS))))
    # a leaf of many rows is salted, and its queries are of several groups
    salts = np.maximum(np.array(tree.rows) // SALT_ROWS, 1).astype(np.int64)
    shared = Shared(spark, (tree, salts, *_groups(tree, groups, salts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, salts, _, _ = shared.value
        for batch in batches:
            leaf = t.descend(vs.matrix(batch.column(1), dim).astype(np.float64))
            salt = (nt.mix(nt.as_word(batch.column(0).to_numpy())) % salts[leaf].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), *batch.columns], names=["leaf", "salt", "id", "vec", "asks"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A leaf's rows in blocks, and its queries with the leaves that they visit, a bit each."""
        t, salts, first, last = shared.value
        for batch in batches:
            of, salt, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), vs.matrix(batch.column(3), dim)
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])])) if len(of) else []
            for a, end in zip(edge, [*edge[1:], len(of)]):
                leaf = int(of[a])
                grp = int(first[leaf] + salt[a] * (last[leaf] - first[leaf] + 1) // salts[leaf])
                rows, q = np.flatnonzero(~asks[a:end]) + a, np.flatnonzero(asks[a:end]) + a
                for b in range(0, len(rows), BLOCK):
                    yield out(leaf, grp, ids[rows[b : b + BLOCK]], x[rows[b : b + BLOCK]], None)
                for b in range(0, len(q), BLOCK):
                    own = q[b : b + BLOCK]
                    seen = np.zeros((len(own), len(t.children)), bool)
                    for i, order in enumerate(t.visits(x[own].astype(np.float64), visits)):
                        seen[i, order] = True
                    yield out(leaf, grp, ids[own], x[own], np.packbits(seen, axis=1).tobytes())

    def out(leaf: int, grp: int, ids: np.ndarray, x: np.ndarray, seen: bytes | None) -> pa.RecordBatch:
        values = (leaf, grp, ids.astype("<i8").tobytes(), x.astype("<f4").tobytes(), seen)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["leaf", "grp", "ids", "vecs", "seen"])

    def bits(raw: bytes, rows: int, width: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, :width].astype(bool)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(shared.value[0].children)
        for batch in batches:
            for grp, raw, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                leaf = np.flatnonzero(bits(raw, n, width).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.full(len(leaf), grp, np.int32))], names=["leaf", "to"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(shared.value[0].children)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best, seen = None, None
        for batch in batches:
            for leaf, i, v, raw in zip(*(batch.column(j).to_pylist() for j in range(4))):
                ids, x = np.frombuffer(i, "<i8").astype(np.int64), np.frombuffer(v, "<f4").reshape(-1, dim)
                if raw is not None:  # the group's queries come first
                    held.append((ids, x, bits(raw, len(ids), width)))
                    continue
                if best is None:
                    best, seen = vs.Best(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k), np.concatenate([h[2] for h in held])
                best.offer(np.flatnonzero(seen[:, leaf]), ids, x)
        if best is not None:
            yield best.batch()

    placed = own.mapInArrow(place, "leaf bigint, salt int, id bigint, vec array<float>, asks boolean")
    blocks = placed.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt", "id")
    blocks = cut(blocks.mapInArrow(block, "leaf bigint, grp int, ids binary, vecs binary, seen binary"))
    asked = blocks.where("seen is not null")
    to = asked.select("grp", "seen", (F.length("ids") / 8).cast("int").alias("n")).mapInArrow(wanted, "leaf bigint, to int").distinct()
    data = blocks.where("seen is null").drop("grp").join(to, "leaf").select(F.col("to").alias("grp"), F.lit(1).alias("kind"), "leaf", "ids", "vecs", "seen")
    sent = asked.select("grp", F.lit(0).alias("kind"), "leaf", "ids", "vecs", "seen").union(data)
    sent = sent.repartitionById(groups, F.col("grp")).sortWithinPartitions("grp", "kind", "leaf").select("leaf", "ids", "vecs", "seen")
    return vs.ranked(sent.mapInArrow(visit, vs.PAIRS), k)


def _groups(tree: Tree, groups: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last group of each leaf: leaves that are near in the tree go together, large ones are shared."""
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        stack += reversed(tree.children[node])
        if not tree.children[node]:
            order.append(node)
    first, last = (np.zeros(len(tree.children), np.int64) for _ in range(2))
    rows = np.maximum(np.array(tree.rows)[order], 1e-9)
    ends = np.cumsum(rows) / rows.sum() * groups
    first[order] = np.minimum(np.concatenate([[0], ends[:-1]]).astype(np.int64), groups - 1)
    last[order] = np.clip(np.ceil(ends - 1e-9).astype(np.int64) - 1, first[order], np.minimum(first[order] + salts[order] - 1, groups - 1))
    return first, last
