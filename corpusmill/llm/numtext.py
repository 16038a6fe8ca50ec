"""Vectorised text primitives on Arrow string arrays.

Texts are handled as one flat byte buffer per slice; words, hashes and windows
are whole-array numpy operations, so that no Python code runs per word.

Every 64-bit hash here is a polynomial over already mixed inputs followed by a
finaliser. Two different inputs collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 20
MOST_RANGES = 1 << 17

#: Bytes that end a word: ASCII white space, or all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more, kept between calls."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = U64(pow(key, -1, 1 << 64))
        up, down = np.full(size, base, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > 4 * SLICE_BYTES:  # one very long text should not hold the memory
            return have
        _powers[key] = have
    return have


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_bounds(buf: np.ndarray, off: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the texts."""
    inside = ~ends[buf]
    first, last = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    first[off] = last[off] = True  # a text's edge is a word's edge
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | last[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return begin, stop, np.searchsorted(begin, off)


def span_hash(values: np.ndarray, begin: np.ndarray, stop: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """64-bit hash of each values[begin:stop]; equal spans have equal hashes."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=total[1:])
    return mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(U64))


def word_hashes(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return span_hash(buf.astype(U64) + U64(1), begin, stop)


def ngrams(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each text's words, and their n + 1 offsets.

    A text of fewer than n words, but one at least, has one n-gram: all its words.
    """
    count = np.diff(off)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(grams)])
    rows = np.repeat(np.arange(len(count)), grams)
    begin = np.arange(at[-1]) - at[rows] + off[rows]
    stop = np.minimum(begin + n, off[rows + 1])
    return span_hash(words, begin, stop, STEP), at


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each integer, byte by byte, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel().astype(U64, copy=False), at + n * width


def width_of(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integer arrays as one value: lengths and widths, then byte planes."""
    widths = [width_of(a) for a in arrays]
    head = np.array([len(arrays), *(v for a, w in zip(arrays, widths) for v in (len(a), w))], "<u4").tobytes()
    return head + b"".join(planes(a, w) for a, w in zip(arrays, widths))


def unpack(raw: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(raw, "<u4", 1)[0])
    head = np.frombuffer(raw, "<u4", 2 * k, 4)
    at, out = 4 + 8 * k, []
    for n, w in head.reshape(-1, 2).tolist():
        x, at = unplanes(raw, at, n, w)
        out.append(x)
    return out


def ranges(table: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Into how many ranges of a hash the shuffles of a table of texts are cut: as the session
    says, and more where a range would get over ``bytes_each`` of the files' bytes."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 60  # a plan that does not start from files has no size
    return max(parts, min(-(-size // bytes_each), MOST_RANGES)) if known else parts


def tidy(run):
    """``run`` for mapInArrow, returning its memory when a task ends: workers are used again,
    and what an allocator keeps would count beside the next task's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def lists(flat_values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array made of a flat array and its offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat_values, kind))


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer."""
    return np.ascontiguousarray(x, U64).view(np.int64)


def as_word(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(U64)
