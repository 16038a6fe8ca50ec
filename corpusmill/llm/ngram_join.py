"""N-gram Jaccard self-join by vertical partitioning.

Two documents pair when the Jaccard similarity of their sets of word n-grams is
at least a threshold t. Words are maximal runs of letters, digits and non-ASCII
characters of the lower-cased text. A text of fewer than n words (one at least)
has one n-gram, all its words.

Plan
1. Each text becomes a set of 64-bit n-gram hashes; the set's own hash ("node")
   stands for all documents with that set, so copies cost one set each.
2. The order of all n-grams is cut into ranges, one per shuffle partition. Blocks
   (n-grams delta-coded, node, set size) go to their range. There the frequency
   of each n-gram is exact; those of a single node drop out, and n-grams with
   the same list of nodes merge into one weighted list.
3. Back by node, many nodes' lists in one value: a node with fewer than
   ceil(t * size) shared n-grams cannot pair and drops out. The others know their
   prefix in the global order (rarest first): similar sets share an entry of both
   prefixes.
4. Each prefix entry is led by the node of the longest prefix that has it. A leader and
   all nodes of its entries are a block: a block never grows over others, as components
   do, which n-grams shared by chance join into one in a large table. A pair
   that meets in several blocks is counted in the first of them only.
5. A block of many sets is cut into tiles of two strips of sizes that can reach t. The
   order of the lists is cut into fragments, at least ``FRAGMENTS``; each fragment of
   each tile counts the overlaps of its part as a matrix product, in a task of its own.
   The partial counts are summed per pair where the tile's fragments meet, and the
   threshold decides.
Every step is exact but for 64-bit hash collisions. No candidate is capped.

Result of ``similar_classes``: (doc_id, class_id, links), one row per document.
``links`` is the number of other documents at the threshold or over it, copies
included. Documents that are similar, directly or over others, are one class, named
by its smallest id. ``similar_pairs`` lists the pairs themselves.

Defined results
    null text, or no word in it: a class of its own, no links. Null id: not taken part.
    Repeated rows (same id): one document if the sets agree; each different set of
    one id is a row, and counts as another document. Ties do not arise. Empty table:
    no rows. Ids are integers, or what casts to bigint. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import numtext as nt
from corpusmill.llm.components import spread_labels
from corpusmill.session import cut

N, THRESHOLD = 5, 0.4
#: Fragments of the order that any block has; a large block has more, of about so many entries.
FRAGMENTS, FRAGMENT_ENTRIES = 4, 1_000_000
#: Sets in a strip of a large block, about.
STRIP = 1024
#: Texts of about so many bytes are cut into n-grams at once.
MAP_BYTES = 12 << 20
BLOCK, WIDTH = 1024, 4096


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (flat), their offsets, and each set's hash."""
    buf, off = nt.flat(pc.utf8_lower(pc.fill_null(texts, "")))
    grams, sizes, nodes = [], [np.zeros(1, np.int64)], []
    for a, b in nt.slices(off):
        part = buf[off[a] : off[b]]
        begin, stop, words = nt.word_bounds(part, off[a : b + 1] - off[a], nt.NOT_ALNUM)
        g, at = nt.ngrams(nt.word_hashes(part, begin, stop), words, n)
        row = np.repeat(np.arange(b - a), np.diff(at))
        keep = ~repeats(g, row)
        g, row = g[keep], row[keep]
        size = np.bincount(row, minlength=b - a)
        node = np.zeros(b - a, nt.U64)
        some = np.flatnonzero(size)
        if len(some):
            start = (np.cumsum(size) - size)[some]
            node[some] = nt.mix(np.add.reduceat(nt.mix(g), start) + size[some].astype(nt.U64))
        grams.append(g)
        sizes.append(size)
        nodes.append(node)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(grams, nt.U64), np.cumsum(np.concatenate(sizes)), cat(nodes, nt.U64)


def repeats(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether an equal (key, other) stands elsewhere and is the one kept."""
    out = np.zeros(len(key), bool)
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    runs = order[same[1:] | same[:-1]]
    if len(runs):
        runs = runs[np.lexsort((runs, other[runs], key[runs]))]
        out[runs[1:]] = (key[runs[1:]] == key[runs[:-1]]) & (other[runs[1:]] == other[runs[:-1]])
    return out


def run_starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _blocks(n: int, ranges: int):
    """Map side: (part, blob) with the n-grams of a range of the order, and the sets they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for a, b in nt.slices(nt.flat(text)[1], MAP_BYTES):
                yield blocks(text.slice(a, b - a))

    def blocks(text: pa.Array) -> pa.RecordBatch:
        g, at, node = gram_sets(text, n)
        row = np.repeat(np.arange(len(node)), np.diff(at))
        first = np.zeros(len(node), bool)
        first[np.unique(node, return_index=True)[1]] = True  # copies in a batch go once
        keep = first[row]
        g, row = g[keep], row[keep]
        order = np.argsort(g)
        g, row = g[order], row[order]
        part = ((g >> nt.U64(32)) * nt.U64(ranges)) >> nt.U64(32)
        edge = np.searchsorted(part, np.arange(ranges + 1, dtype=nt.U64))
        size = np.diff(at)
        parts, blobs = [], []
        for p in range(ranges):
            a, b = edge[p], edge[p + 1]
            if a < b:
                used, local = np.unique(row[a:b], return_inverse=True)
                parts.append(p)
                blobs.append(nt.pack(np.diff(g[a:b], prepend=nt.U64(0)), local, node[used], size[used]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), nt.binaries(blobs)], names=["part", "blob"])

    return run


def _shared_lists(parts: int):
    """One range of the order: (part, blob) with the weighted lists, of two nodes or more, of a range of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shared_lists(batches, parts)

    return run


def shared_lists(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """See ``_shared_lists``. Names are hashes, so that a slice of the sorted names is a range of nodes."""
    gs, ns, nodes, sizes, have = [], [], [], [], 0
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            delta, local, node, size = nt.unpack(raw)
            gs.append(np.cumsum(delta))
            ns.append(local.astype(np.int64) + have)
            nodes.append(node)
            sizes.append(size)
            have += len(node)
    if not gs:
        return
    names, at = np.unique(np.concatenate(nodes), return_index=True)
    size = np.concatenate(sizes)[at]
    which = np.searchsorted(names, np.concatenate(nodes)).astype(np.int32)[np.concatenate(ns)]
    g = np.concatenate(gs)
    del gs, ns, nodes, sizes
    keep = ~repeats(g, which)
    g, which = g[keep], which[keep]
    order = np.argsort(g)
    g, which = g[order], which[order]
    start = run_starts(g)
    df = np.diff(np.append(start, len(g)))
    many = df > 1
    which, df = which[np.repeat(many, df)], df[many]
    if not len(df):
        return
    start = np.cumsum(df) - df
    label = nt.mix(np.add.reduceat(nt.mix(names[which]), start) + df.astype(nt.U64))
    lists, one, weight = np.unique(label, return_index=True, return_counts=True)
    length = df[one]
    rows = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start[one], length)
    member, entry = which[rows], np.repeat(np.arange(len(lists)), length)
    order = np.argsort(member, kind="stable")
    member, entry = member[order], entry[order]
    off = np.append(run_starts(member), len(member))
    who = member[off[:-1]]
    part = ((names[who] >> nt.U64(32)) * nt.U64(parts)) >> nt.U64(32)
    edge = np.append(run_starts(part), len(part))
    for i in range(0, len(edge) - 1, 256):
        blobs = []
        for a, b in zip(edge[i : i + 256], edge[i + 1 : i + 257]):
            e = entry[off[a] : off[b]]
            blobs.append(nt.pack(names[who[a:b]], size[who[a:b]], np.diff(off[a : b + 1]), lists[e], weight[e], length[e]))
        yield pa.RecordBatch.from_arrays([pa.array(part[edge[i : i + len(blobs)]].astype(np.int32)), nt.binaries(blobs)], names=["part", "blob"])


def _vectors(threshold: float):
    """One range of nodes: those with enough shared n-grams, their lists merged, and the prefix in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [nt.unpack(raw) for batch in batches for raw in batch.column(1).to_pylist()]
        if not have:
            return
        node, size, many, name, weight, df = (np.concatenate([h[i] for h in have]) for i in range(6))
        del have
        node, first, who = np.unique(node, return_index=True, return_inverse=True)
        size, weight = size[first].astype(np.int64), weight.astype(np.int64)
        who = np.repeat(who, many.astype(np.int64))
        shared = np.bincount(who, weights=weight, minlength=len(node)).astype(np.int64)
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        keep = (shared >= least)[who]
        who, name, weight, df = who[keep], name[keep], weight[keep], df[keep]
        if not len(who):
            return
        order = np.lexsort((name, df, who))
        who, name, weight = who[order], name[order], weight[order]
        start = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (name[1:] != name[:-1])]))
        who, name, weight = who[start], name[start], np.add.reduceat(weight, start)
        off = np.append(run_starts(who), len(who))
        alive = who[off[:-1]]
        before = np.cumsum(weight) - weight
        before -= np.repeat(before[off[:-1]], np.diff(off))
        early = before < (shared - least + 1)[who]
        ahead = np.concatenate([[0], np.cumsum(early)])
        for a in range(0, len(alive), 5000):
            o = off[a : a + 5001]
            here = slice(o[0], o[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nt.as_long(node[alive[a : a + 5000]])),
                    pa.array(size[alive[a : a + 5000]]),
                    nt.lists(nt.as_long(name[here]), o - o[0], pa.int64()),
                    nt.lists(weight[here], o - o[0], pa.int64()),
                    nt.lists(nt.as_long(name[here][early[here]]), ahead[o] - ahead[o[0]], pa.int64()),
                ],
                names=["node", "size", "lists", "weights", "prefix"],
            )

    return run


def _overlaps(threshold: float):
    """Partial overlaps of one fragment of the order in one tile: (label, a, b, blob).

    The blob holds the sets, their sizes and copies, and each pair with its count. Pairs
    that also meet in an earlier block are left to it.
    """

    def columns(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name, back = np.unique(np.concatenate(values), return_inverse=True)
        return name, back, np.concatenate([[0], np.cumsum([len(x) for x in values])])

    def count(size: np.ndarray, own: np.ndarray, lists: list, weights: list, earlier: list, square: bool):
        name, back, off = columns(lists)
        weight = np.zeros(len(name), np.float32)
        weight[back] = np.concatenate(weights)
        block, at, its = columns(earlier)
        m, half = len(size), len(size) if square else int(own.sum())
        for i in range(0, half, BLOCK):
            for j in range(i if square else half, m, BLOCK):
                rows, cols = min(BLOCK, half - i), min(BLOCK, m - j)
                if size[i + rows - 1] < threshold * size[j]:
                    break  # sorted: all further sets are larger still
                if size[j + cols - 1] < threshold * size[i]:
                    continue
                total = np.zeros((rows, cols), np.float32)
                for c in range(0, len(name), WIDTH):
                    total += dense(back, off, i, i + rows, c, len(name)) * weight[c : c + WIDTH] @ dense(back, off, j, j + cols, c, len(name)).T
                for c in range(0, len(block), WIDTH):
                    total[dense(at, its, i, i + rows, c, len(block)) @ dense(at, its, j, j + cols, c, len(block)).T > 0] = 0
                x, y = np.nonzero(total)
                both = total[x, y].astype(np.int64)
                x, y = x + i, y + j
                fit = (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])) & ((x < y) | (not square))
                yield x[fit], y[fit], both[fit]

    def dense(back, off, i, end, c, width) -> np.ndarray:
        a, b = off[i], off[end]
        out = np.zeros((end - i, min(WIDTH, width - c)), np.float32)
        row = np.repeat(np.arange(end - i), np.diff(off[i : end + 1]))
        col = back[a:b]
        here = (col >= c) & (col < c + WIDTH)
        out[row[here], col[here] - c] = 1
        return out

    def tile(key: tuple, rows: list) -> Iterator[pa.RecordBatch]:
        label, a, b, _ = key
        node, size, copies, strip = (np.array([r[i] for r in rows]) for i in range(4))
        order = np.lexsort((node, size, strip != a))
        node, size, copies, strip = node[order], size[order], copies[order], strip[order]
        if a != b and (strip == a).all() or (strip == b).all() and a != b or len(node) < 2:
            return
        found = list(count(size, strip == a, *([rows[i][c] for i in order] for c in (4, 5, 6)), a == b))
        x, y, both = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        if len(x):
            used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
            blob = nt.pack(nt.as_word(node[used]), size[used], copies[used], back[: len(x)], back[len(x) :], both)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label]), pa.array([a], pa.int64()), pa.array([b], pa.int64()), nt.binaries([blob])], names=["label", "a", "b", "blob"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple = ((), [])
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            rest = [batch.column(i).to_pylist() for i in range(4, 8)]
            flat = []
            for i in (8, 9, 10):
                o, v = batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy()
                flat.append([v[x:y] for x, y in zip(o[:-1].tolist(), o[1:].tolist())])
            for key, *row in zip(keys, *rest, *flat):
                if key != have[0]:
                    if have[1]:
                        yield from tile(*have)
                    have = (key, [])
                have[1].append(row)
        if have[1]:
            yield from tile(*have)

    return run


def _totals(threshold: float, links: bool):
    """A tile's partial overlaps summed per pair, and the threshold.

    ``links``: (node, links, root) for each set of a pair, the smallest set that it hangs
    on in this tile; else the pairs, (a, b, both, sizes).
    """

    def total(blobs: list[bytes]) -> pa.RecordBatch | None:
        parts = [nt.unpack(raw) for raw in blobs]
        node, one = np.unique(np.concatenate([nt.as_long(p[0]) for p in parts]), return_index=True)
        size, copies = (np.concatenate([p[i] for p in parts])[one].astype(np.int64) for i in (1, 2))
        at = [np.searchsorted(node, nt.as_long(p[0])) for p in parts]
        x, y = (np.concatenate([w[p[i].astype(np.int64)] for w, p in zip(at, parts)]) for i in (3, 4))
        both = np.concatenate([p[5] for p in parts]).astype(np.int64)
        low, high = np.minimum(x, y), np.maximum(x, y)
        key, back = np.unique(low * len(node) + high, return_inverse=True)
        both = np.bincount(back, weights=both).astype(np.int64)
        x, y = key // len(node), key % len(node)
        fit = both / (size[x] + size[y] - both) >= threshold
        x, y, both = x[fit], y[fit], both[fit]
        if not len(x):
            return None
        if not links:
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(both), pa.array(size[x] + size[y])], names=["a", "b", "both", "sizes"])
        group = np.arange(len(node))
        unite(group, x, y)
        group = roots(group)
        many = np.bincount(x, weights=copies[y], minlength=len(node)) + np.bincount(y, weights=copies[x], minlength=len(node))
        some = np.flatnonzero(many)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(many[some].astype(np.int64)), pa.array(node[group[some]])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple = ((), [])
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for key, raw in zip(keys, batch.column(3).to_pylist()):
                if key != have[0]:
                    if have[1] and (out := total(have[1])):
                        yield out
                    have = (key, [])
                have[1].append(raw)
        if have[1] and (out := total(have[1])):
            yield out

    return run


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of each x and y; the smaller root stays."""
    while True:
        parent[:] = roots(parent)
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def document_sets(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, node): the hash of each document's set; null where it has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, node = gram_sets(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nt.as_long(node), mask=np.diff(at) == 0)], names=["doc", "node"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text_")).where("doc is not null")
    return rows.mapInArrow(nt.tidy(run), "doc bigint, node bigint")


def _vectors_of(docs: DataFrame, n: int, threshold: float, text_col: str) -> DataFrame:
    """(node, size, lists, weights, prefix) of the sets that share enough n-grams to pair."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    parts = nt.ranges(docs)
    texts = docs.select(F.col(text_col).alias("text_")).where("text_ is not null")
    blocks = texts.mapInArrow(nt.tidy(_blocks(n, parts)), "part int, blob binary")
    shared = blocks.repartitionById(parts, F.col("part")).mapInArrow(nt.tidy(_shared_lists(parts)), "part int, blob binary")
    vectors = shared.repartitionById(parts, F.col("part")).mapInArrow(nt.tidy(_vectors(threshold)), "node bigint, size bigint, lists array<bigint>, weights array<bigint>, prefix array<bigint>")
    return cut(vectors)


def _members(vectors: DataFrame) -> DataFrame:
    """(node, label): the blocks of each set, by their leaders. Similar sets share one at least."""
    entries = vectors.select("node", F.size("prefix").alias("length"), F.explode("prefix").alias("hub"))
    led = entries.groupBy("hub").agg(F.max(F.struct("length", "node"))["node"].alias("label"), F.count("*").alias("sets")).where("sets > 1")
    return entries.join(led, "hub").select("node", "label").distinct()


def _tiles(vectors: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """Sets in tiles and fragments: (label, a, b, frag, node, size, copies, strip, lists, weights, earlier).

    A block of over ``STRIP`` sets is cut into strips by size and then by hash; tiles are the
    pairs of strips whose sizes can reach the threshold. Each tile has every fragment.
    ``earlier``: the set's blocks of smaller labels.
    """
    # seats are placed without the sets' lists, which join them once
    seats = cut(_members(vectors).join(vectors.select("node", "size", F.size("lists").alias("entries")), "node"))
    cost = seats.groupBy("label").agg(F.greatest(F.lit(FRAGMENTS), F.ceil(F.sum("entries") / FRAGMENT_ENTRIES)).cast("int").alias("of"), (F.count("*") > STRIP).alias("split"))
    placed = seats.drop("entries").join(cost, "label")
    steps = 4  # classes of size from the threshold to 1
    level = F.floor(F.log("size") * (steps / -math.log(threshold)) + 1e-9).cast("bigint") if threshold < 1 else F.col("size")
    large = placed.where("split").withColumn("class", level)
    counts = large.groupBy("label", "class").agg(F.ceil(F.count("*") / STRIP).alias("salts"))
    large = large.join(counts, ["label", "class"]).withColumn("strip", F.col("class") * (1 << 24) + F.pmod(F.xxhash64("node"), "salts"))
    strips = counts.withColumn("strip", F.explode(F.transform(F.sequence(F.lit(0), F.col("salts").cast("int") - 1), lambda i: F.col("class") * (1 << 24) + i)))
    one = strips.select("label", F.col("class").alias("ca"), F.col("strip").alias("a"))
    two = strips.select("label", F.col("class").alias("cb"), F.col("strip").alias("b"))
    pairs = one.join(two, "label").where(f"a <= b and cb - ca <= {steps + 1 if threshold < 1 else 0}").select("label", "a", "b")
    of_strip = pairs.select("label", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("strip"))
    keys = ["label", "a", "b", "of", "node", "strip"]
    small = placed.where("not split").withColumns({"a": F.lit(0).cast("bigint"), "b": F.lit(0).cast("bigint"), "strip": F.lit(0).cast("bigint")})
    tiles = small.select(keys).union(large.join(of_strip, ["label", "strip"]).select(keys))
    blocks = seats.groupBy("node").agg(F.collect_list("label").alias("blocks"))
    tiles = tiles.join(vectors.drop("prefix").join(blocks, "node").join(copies, "node"), "node")
    tiles = tiles.withColumn("earlier", F.filter("blocks", lambda x: x < F.col("label")))
    # a fragment is a range of the list order
    at = F.transform("lists", lambda x: F.pmod(F.shiftrightunsigned(x, 1), F.col("of")).cast("int"))
    tiles = tiles.withColumn("at", at).withColumn("frag", F.explode(F.array_distinct("at")))
    pick = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("v"), F.col("at").alias("f")), lambda z: z["f"] == F.col("frag")), lambda z: z["v"])
    return tiles.select("label", "a", "b", "frag", "node", "size", "copies", "strip", pick("lists").alias("lists"), pick("weights").alias("weights"), "earlier")


def _counted(tiles: DataFrame, threshold: float, links: bool) -> DataFrame:
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["label", "a", "b", "frag"]
    partial = tiles.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(nt.tidy(_overlaps(threshold)), "label bigint, a bigint, b bigint, blob binary")
    schema = "node bigint, links bigint, root bigint" if links else "a bigint, b bigint, both bigint, sizes bigint"
    return partial.repartition(parts, *key[:3]).sortWithinPartitions(*key[:3]).mapInArrow(nt.tidy(_totals(threshold, links)), schema)


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(a, b, jaccard): pairs of different sets, by their hashes."""
    vectors = _vectors_of(docs, n, threshold, text_col)
    pairs = _counted(_tiles(vectors, vectors.select("node", F.lit(1).cast("bigint").alias("copies")), threshold), threshold, False)
    return pairs.select("a", "b", (F.col("both") / (F.col("sizes") - F.col("both"))).alias("jaccard"))


def set_groups(docs: DataFrame, of: DataFrame, n: int = N, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(node, label, links) of each set that is similar to another.

    ``of``: (doc, node). Sets that are similar, directly or over others, have one label;
    ``links`` counts the documents of the sets that reach the threshold with it. A pair of
    sets never leaves the task that sums it.
    """
    copies = of.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    found = cut(_counted(_tiles(_vectors_of(docs, n, threshold, text_col), copies, threshold), threshold, True))
    labels = spread_labels(found.select("node", F.col("root").alias("hub")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return labels.select("node", "label").join(links, "node")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of representatives, and each other copy with its own (jaccard 1).

    The representative is the smallest id with an equal set. All pairs of documents are
    these with each representative replaced by any of its copies.
    """
    of = cut(document_sets(docs, n, id_col, text_col).where("node is not null").distinct())
    first = of.groupBy("node").agg(F.min("doc").alias("rep"))
    copies = of.join(first, "node").where("doc <> rep").select(F.col("rep").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    pairs = similar_sets(docs, n, threshold, text_col)
    near = pairs.join(first.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(first.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    near = near.where("ra <> rb").select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return copies.union(near).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def similar_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links): see the module's text."""
    of = cut(document_sets(docs, n, id_col, text_col).distinct())
    groups = set_groups(docs, of, n, threshold, text_col)
    sets = of.where("node is not null").groupBy("node").agg(F.min("doc").alias("rep"), F.count("*").alias("same"))
    sets = cut(sets.join(groups, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"), (F.col("same") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    least = sets.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = sets.join(least, "label").select("node", "class_id", "links")
    return of.join(known, "node", "left").select(F.col("doc").alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def one_per_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are similar, directly or over others, to one of a smaller id.

    An id goes if any of its texts is in a class of a smaller id. Documents without a word or an id stay.
    """
    gone = similar_classes(docs, n, threshold, id_col, text_col).where("class_id < doc_id").select(F.col("doc_id").alias("gone_")).distinct()
    gone = cut(gone)
    return docs.join(gone, docs[id_col].cast("bigint") == gone["gone_"], "left_anti")
