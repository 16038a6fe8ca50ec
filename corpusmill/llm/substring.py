"""Substring dedup by difference-cover anchors.

A passage repeats when ``length`` words in a row (runs of non-white-space bytes,
compared byte by byte) stand at two places or more of the corpus, in two documents
or in one. Every such place is found; the first by (doc_id, position) counts as the
original.

Plan
1. A difference cover D modulo v holds two residues for every difference, so two
   equal passages at any offsets share an aligned position of both covers within
   the first v words. Each text hashes only the windows of ``length - v + 1`` words
   that start at its cover positions (|D| / v of all). Hashes go to the range of the
   hash space that owns them, one shuffle row per batch and range; a hash that
   stands at one place only drops out there.
2. The surviving anchors are joined to their texts, and extend: every window of
   ``length`` words around an anchor is hashed, and again grouped by range. No pair
   of places is ever formed, so a passage with thousands of copies costs its copies.
3. Runs of windows become spans of words.
``remove_repeats`` cuts every word under a later window, and does so again on what is
left, as words that come together make new windows, until no window stands twice.
Every step is exact but for 64-bit hash collisions; nothing is capped.

Defined results
    null text, or fewer words than ``length``: no row. Null ids are documents too,
    ordered last. Repeated rows (same id and text): one document. Same id with
    other text: another document, ordered by a hash of the text. Empty table: no
    rows. Other columns are not read by ``repeated_spans`` and kept by
    ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import numtext as nt
from corpusmill.session import cut, drop_cut

LENGTH = 50
#: Perfect difference sets: every non-zero difference modulo the period once.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (1, 6, 7, 9, 19, 38, 42, 49)}


def period_for(length: int) -> int:
    """The largest period that leaves anchors of over a third of ``length``."""
    fit = [v for v in COVERS if length - v + 1 >= max(1, length / 3)]
    return max(fit, default=0)


def cover_of(period: int) -> np.ndarray:
    """Whether each residue is in the cover; without a period every position is."""
    out = np.zeros(max(period, 1), bool)
    out[list(COVERS.get(period, (0,)))] = True
    return out


def to_ranges(h: np.ndarray, row: np.ndarray, pos: np.ndarray, key: np.ndarray, rank: np.ndarray, ranges: int) -> tuple[list[int], list[bytes]]:
    """One packed value for each range of the hash space that has hashes of this batch."""
    order = np.argsort(h)
    h, row, pos = h[order], row[order], pos[order]
    part = ((h >> nt.U64(32)) * nt.U64(ranges)) >> nt.U64(32)
    edge = np.searchsorted(part, np.arange(ranges + 1, dtype=nt.U64))
    parts, blobs = [], []
    for p in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[p], edge[p + 1]
        used, local = np.unique(row[a:b], return_inverse=True)
        parts.append(p)
        blobs.append(nt.pack(np.diff(h[a:b], prepend=nt.U64(0)), local, pos[a:b], key[used], rank[used]))
    return parts, blobs


def from_ranges(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """All of a range, sorted by hash, then by document and position; repeated rows once."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            delta, local, pos, key, rank = nt.unpack(raw)
            local = local.astype(np.int64)
            for c, x in zip(cols, (np.cumsum(delta), pos, key[local], rank[local])):
                c.append(x)
    if not cols[0]:
        return None
    h, pos, key, rank = (np.concatenate(c) for c in cols)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    many = np.zeros(len(h) + 1, bool)
    many[1:-1] = same
    order = order[many[1:] | many[:-1]]
    h, pos, key, rank = h[order], pos[order], key[order], rank[order]
    order = np.lexsort((pos, key, rank, h))
    h, pos, key, rank = h[order], pos[order], key[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    return h[new], pos[new], key[new], rank[new]


def by_key(key: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    values = tuple(v[order] for v in values)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(start.tolist(), np.append(start[1:], len(key)).tolist()):
        yield key[a], [v[a:b] for v in values]


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    begin, stop, at = nt.word_bounds(buf, off, nt.SPACE)
    return nt.word_hashes(buf, begin, stop), at, begin, stop


def _rank(ids: pa.Array) -> np.ndarray:
    """Ids as unsigned integers in the same order, null last."""
    x = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
    return nt.as_word(x) ^ nt.U64(1 << 63)


def _emit(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), nt.binaries(blobs)], names=["part", "blob"])


def _anchors(length: int, period: int, ranges: int):
    cover = cover_of(period)
    size = length - max(period, 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = nt.as_word(batch.column(0).to_numpy())
            buf, off = nt.flat(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in nt.slices(off):
                words, at, _, _ = words_of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n = np.diff(at)
                room = np.where(n >= length, n - size + 1, 0)
                row = np.repeat(np.arange(b - a), room)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(room) - room, room)
                keep = cover[pos % len(cover)]
                row, pos = row[keep], pos[keep]
                begin = at[row] + pos
                for o, x in zip(out, (nt.span_hash(words, begin, begin + size, nt.STEP), row + a, pos)):
                    o.append(x)
            if out[0]:
                h, row, pos = (np.concatenate(o) for o in out)
                yield _emit(*to_ranges(h, row, pos, key, np.zeros(len(key), nt.U64), ranges))

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of anchors: per document the positions whose anchor stands elsewhere too."""
    found = from_ranges(batches)
    if found is None or not len(found[0]):
        return
    h, pos, key, _ = found
    many = np.zeros(len(h) + 1, bool)
    many[1:-1] = h[1:] == h[:-1]
    many = many[1:] | many[:-1]
    rows = list(by_key(key[many], pos[many]))
    for a in range(0, len(rows), 20000):
        part = rows[a : a + 20000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nt.as_long(np.array([k for k, _ in part], nt.U64))), nt.binaries([nt.pack(np.sort(v[0])) for _, v in part])], names=["key", "blob"]
        )


def _windows(length: int, period: int, ranges: int):
    reach = max(period, 1) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rank = nt.as_word(batch.column(0).to_numpy()), _rank(batch.column(1))
            buf, off = nt.flat(batch.column(2))
            marks = batch.column(3).to_pylist()
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in nt.slices(off):
                words, at, _, _ = words_of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                near = np.zeros(len(words) + 1, np.int32)
                for i in range(a, b):
                    p = np.concatenate([nt.unpack(x)[0] for x in marks[i]]).astype(np.int64)
                    first, last = at[i - a], at[i - a + 1] - length
                    np.add.at(near, first + np.maximum(p - reach, 0), 1)
                    np.add.at(near, np.maximum(np.minimum(first + p, last) + 1, first), -1)
                begin = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                row = np.searchsorted(at, begin, "right") - 1
                fits = begin + length <= at[row + 1]
                begin, row = begin[fits], row[fits]
                for o, x in zip(out, (nt.span_hash(words, begin, begin + length, nt.STEP), row + a, begin - at[row])):
                    o.append(x)
            if out[0]:
                h, row, pos = (np.concatenate(o) for o in out)
                yield _emit(*to_ranges(h, row, pos, key, rank, ranges))

    return run


def _originals(length: int):
    """Per document its repeated windows: the originals, the others, and those of the others that overlap their own original, with its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = from_ranges(batches)
        if found is None or not len(found[0]):
            return
        h, pos, key, _ = found
        same = h[1:] == h[:-1]
        later, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
        later[1:] = same
        first[:-1] = same & ~later[:-1]
        source = np.maximum.accumulate(np.where(later, 0, np.arange(len(h))))
        near = later & (key == key[source]) & (pos.astype(np.int64) - pos[source].astype(np.int64) < length)
        many = later | first
        rows = list(by_key(key[many], pos[many], first[many], near[many], pos[source][many]))
        for a in range(0, len(rows), 20000):
            part = rows[a : a + 20000]
            blobs = [nt.pack(np.sort(p[f]), np.sort(p[~f]), p[o], q[o]) for _, (p, f, o, q) in part]
            yield pa.RecordBatch.from_arrays([pa.array(nt.as_long(np.array([k for k, _ in part], nt.U64))), nt.binaries(blobs)], names=["key", "blob"])

    return run


def runs_of(pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that windows at these positions cover."""
    pos = np.sort(pos.astype(np.int64))
    if not len(pos):
        return pos, pos
    gap = np.flatnonzero(pos[1:] > pos[:-1] + length)
    return np.concatenate([pos[:1], pos[gap + 1]]), np.concatenate([pos[gap], pos[-1:]]) + length


def _merged(blobs: list[bytes], length: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    parts = [nt.unpack(x) for x in blobs]
    return tuple(runs_of(np.concatenate([p[i] for p in parts]), length) for i in (0, 1))  # type: ignore[return-value]


def _cuts(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans under later windows; of a window that overlaps its own original, what comes after that."""
    _, later, near, source = (np.concatenate(x).astype(np.int64) for x in zip(*(nt.unpack(b) for b in blobs)))
    far = np.setdiff1d(later, near)
    return np.concatenate([far, source + length]), np.concatenate([far, near]) + length


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def marked(docs: DataFrame, length: int, id_col: str, text_col: str, few: bool = False) -> DataFrame:
    """(key, blobs): packed positions of each document's repeated windows. ``few``: where few anchors repeat."""
    if length < 2:
        raise ValueError("a passage has two words at least")
    period = period_for(length)
    ranges = nt.ranges(docs)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        document_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("id_"), F.col(text_col).alias("text_")
    )
    blobs = texts.select("key", "text_").mapInArrow(nt.tidy(_anchors(length, period, ranges)), "part int, blob binary")
    found = blobs.repartitionById(ranges, F.col("part")).mapInArrow(nt.tidy(_repeated), "key bigint, blob binary")
    found = found.groupBy("key").agg(F.collect_list("blob").alias("marks"))
    if few:  # written, so that the planner sees its size and need not shuffle the texts
        found = cut(found)
    near = texts.join(found, "key").select("key", "id_", "text_", "marks")
    blobs = near.mapInArrow(nt.tidy(_windows(length, period, ranges)), "part int, blob binary")
    found = blobs.repartitionById(ranges, F.col("part")).mapInArrow(nt.tidy(_originals(length)), "key bigint, blob binary")
    return found.groupBy("key").agg(F.collect_list("blob").alias("blobs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, original): maximal runs of repeated words.

    ``original`` is true for the first place of a passage and false for the others.
    Ends are exclusive. A run may overlap a run of the other kind.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, start, end, first = [], [], [], []
            for i, blobs in enumerate(batch.column(1).to_pylist()):
                for (a, b), original in zip(_merged(blobs, length), (True, False)):
                    who.append(np.full(len(a), i))
                    start.append(a)
                    end.append(b)
                    first.append(np.full(len(a), original))
            if who:
                row = pa.array(np.concatenate(who).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), *(pa.array(np.concatenate(x)) for x in (start, end, first))], names=["doc_id", "start_word", "end_word", "original"]
                )

    ids = docs.select(document_key(id_col, text_col).alias("key"), F.col(id_col).cast("bigint").alias("doc_id")).distinct()
    found = marked(docs, length, id_col, text_col).join(ids, "key").select("doc_id", "blobs")
    return found.mapInArrow(spans, "doc_id bigint, start_word bigint, end_word bigint, original boolean")


def cut_words(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """The text without the words of these spans."""
    buf = np.frombuffer(text, np.uint8)
    begin, stop, _ = nt.word_bounds(buf, np.array([0, len(buf)]), nt.SPACE)
    edge = np.zeros(len(begin) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    drop = np.cumsum(edge[:-1]) > 0
    if not drop.any():
        return text
    # a dropped word goes with the white space after it
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, begin[drop], 1)
    np.add.at(edge, np.append(begin[1:], len(buf))[drop], -1)
    return buf[np.cumsum(edge[:-1]) == 0].tobytes()


def _without(docs: DataFrame, found: DataFrame, length: int, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    """``docs`` without the words under the later windows of ``found``."""
    names = docs.columns
    at = names.index(text_col)

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, blobs = batch.column(at), batch.column(len(names)).to_pylist()
            new = [
                None if t is None else t if m is None else cut_words(t.encode(), *_cuts(m, length)).decode()
                for t, m in zip(text.to_pylist(), blobs)
            ]
            keep = [m is None or bool(t.strip(" \t\n\v\f\r")) for t, m in zip(new, blobs)]
            columns = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    # the row travels as one struct, so that no name of its columns can clash
    keyed = docs.select(document_key(id_col, text_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    out = keyed.join(found, "key", "left").select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)), "blobs").mapInArrow(nt.tidy(cut_all), docs.schema)
    if chars_col in names:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every repeated passage cut but its first place.

    In the result no ``length`` words in a row stand twice; every word that is cut stands
    at an earlier place, in the same words. Every round cuts a word, so the rounds end.
    Documents of which no word is left go. Where ``chars_col`` exists it follows the text.
    """
    given = docs
    while True:
        found = cut(marked(docs, length, id_col, text_col, few=docs is not given))
        if found.isEmpty():
            drop_cut(found)
            return docs
        left = cut(_without(docs, found, length, id_col, text_col, chars_col))
        drop_cut(found)
        if docs is not given:
            drop_cut(docs)
        docs = left
