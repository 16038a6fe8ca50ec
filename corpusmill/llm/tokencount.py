"""Token counts of a byte-level BPE tokenizer, without materialising token ids.

A byte-level BPE merges inside pre-tokens only, so the tokens of a text are the sum
over its pre-tokens. Corpora repeat pre-tokens: each distinct one is split into
pieces once.

Plan
1. Texts are cut into pre-tokens as array operations; each task reports its distinct
   pre-tokens with their frequency, and one shuffle by hash makes them distinct over
   the corpus. Their pieces are counted there.
2. Texts are read again and give per-document frequencies. The most frequent
   pre-tokens, at most ``broadcast_entries`` of them (10 bytes each), are looked up in
   a broadcast array; the others are joined with the table of step 1 on the hash,
   as (document, pre-token, frequency), and summed per document.
The split is by frequency only; both ways give the same counts. Pre-tokens are told
apart by 64-bit hashes.

Defined results
    One row per distinct (id, text). null or empty text: 0 tokens. Null id: a row
    with null. Repeated rows: one row. Empty table: no rows. Special-token strings
    in a text are ordinary text. Ids are integers, or what casts to bigint. Other
    columns are not read. ``row_counts``: one row per row, with all other columns.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from corpusmill.llm import numtext as nt
from corpusmill.llm.substring import document_key
from corpusmill.llm.words import word_count
from corpusmill.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that ``pretokens`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BROADCAST_ENTRIES = 1 << 20
WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, by the same Unicode tables that the pattern uses."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = "".join(regex.findall(pattern + "+", every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def pretokens(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of every pre-token and the offsets of the texts in them.

    ``code``: code points of all texts; ``off``: the n + 1 offsets of the texts.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    # the last white space before a word stands apart from those before it
    last = white & ~edge[1:]
    last[:-1] &= ~white[1:]
    last[-1] = False
    start |= last
    # and, if it is a blank, the word is attached to it
    blank = last & (code == 32)
    start[1:] &= ~blank[:-1]
    # contractions: an apostrophe that starts a pre-token, then certain letters
    at = np.flatnonzero((code == 39) & start)
    if len(at):
        pad = np.concatenate([code, np.zeros(2, code.dtype)])
        stop = off[np.searchsorted(off, at, "right")]
        one, two = pad[at + 1], pad[at + 2]
        one, two = np.where(at + 1 < stop, one, 0), np.where(at + 2 < stop, two, 0)
        size = np.zeros(len(at), np.int64)
        for s in "stmd":
            size[one == ord(s)] = 1
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        start[after[after < n]] = True
    begin = np.flatnonzero(start)
    return begin, np.searchsorted(begin, off)


def hashed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of UTF-8 texts: hashes, text offsets, and byte bounds."""
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    begin, at = pretokens(code, np.searchsorted(lead, off))
    first = lead[begin]
    stop = np.append(first[1:], len(buf))
    if len(at) > 1 and len(first):  # a text's last pre-token ends with the text
        ends = np.flatnonzero(np.diff(at))
        stop[at[1:][ends] - 1] = off[1:][ends]
    return nt.word_hashes(buf, first, stop), at, first, stop


def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = nt.flat(batch.column(0))
        names, counts, texts = [], [], []
        for a, b in nt.slices(off):
            part = buf[off[a] : off[b]]
            h, _, first, stop = hashed(part, off[a : b + 1] - off[a])
            name, one, n = np.unique(h, return_index=True, return_counts=True)
            length = stop[one] - first[one]
            where = np.concatenate([[0], np.cumsum(length)])
            take = np.arange(where[-1]) - np.repeat(where[:-1], length) + np.repeat(first[one], length)
            texts.append(pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(part[take].tobytes())]))
            names.append(name)
            counts.append(n)
        if names:
            name, one, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nt.as_long(name)), pa.concat_arrays(texts).take(pa.array(one)), pa.array(n)], names=["hash", "token", "n"])


def _pieces(ranks: bytes):
    """One part of the pre-tokens, by hash: each once, with its pieces and total frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
        names, texts, counts = [], [], []
        for batch in batches:
            for x, column in zip((names, texts, counts), batch.columns):
                x.append(column)
        if not names:
            return
        name, one, back = np.unique(pa.concat_arrays(names).to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(back, pa.concat_arrays(counts).to_numpy()).astype(np.int64)
        text = pa.concat_arrays(texts).take(pa.array(one))
        for a in range(0, len(name), 65536):
            pieces = [len(encode(x.decode("utf-8"))) for x in text[a : a + 65536].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(name[a : a + 65536]), pa.array(pieces, pa.int64()), pa.array(n[a : a + 65536])], names=["hash", "pieces", "n"])

    return run


def dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """(hash, pieces, n): every distinct pre-token's piece count and frequency."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    texts = docs.select(F.col(text_col).alias("text_")).where("text_ <> ''")
    found = texts.mapInArrow(nt.tidy(_distinct), "hash bigint, token binary, n bigint").repartition("hash")
    return found.mapInArrow(nt.tidy(_pieces(ranks)), "hash bigint, pieces bigint, n bigint")


def _frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest frequencies, at most ``most``: a threshold from a small histogram."""
    steps = table.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    total, floor = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        floor = step
    return table.where(F.floor(F.log2("n") * 16) >= floor) if floor is not None else table.limit(0)


def row_counts(rows: DataFrame, vocabulary: str | None = VOCABULARY, text_col: str = "text", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """The rows of ``rows`` with their columns but the text, and ``n_tokens``.

    Rows that are alike stay apart. Without a vocabulary, words are counted. The result is
    written as a table once (``session.cut``); only pre-tokens that are not broadcast are
    joined, by the number that a row has in it.
    """
    rest = [c for c in rows.columns if c != text_col]
    if vocabulary is None:
        return cut(rows.select(*rest, word_count(F.col(text_col)).alias("n_tokens")))
    table = cut(dictionary(rows, vocabulary, text_col))
    top = _frequent(table, broadcast_entries).select("hash", "pieces").toArrow()
    hot, pieces = nt.as_word(top["hash"].to_numpy()), top["pieces"].to_numpy()
    order = np.argsort(hot)
    shared = rows.sparkSession.sparkContext.broadcast((hot[order], pieces[order].astype(np.int32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = shared.value
        for batch in batches:
            buf, off = nt.flat(batch.column(0))
            total = np.zeros(batch.num_rows, np.int64)
            rest: list[list[np.ndarray]] = [[], []]
            length = np.zeros(batch.num_rows, np.int64)
            for a, b in nt.slices(off):
                h, at, _, _ = hashed(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                name, back = np.unique(h, return_inverse=True)
                i = np.searchsorted(names, name)
                known = np.zeros(len(name), bool)
                if len(names):
                    i = np.minimum(i, len(names) - 1)
                    known = names[i] == name
                value = np.where(known, values[i] if len(names) else 0, 0)
                before = np.concatenate([[0], np.cumsum(value[back])])
                total[a:b] = before[at[1:]] - before[at[:-1]]
                row = np.repeat(np.arange(a, b), np.diff(at))
                cold = ~known[back]
                pair, n = np.unique(row[cold] * len(name) + back[cold], return_counts=True)
                length[a:b] += np.bincount(pair // max(len(name), 1) - a, minlength=b - a)[: b - a]
                rest[0].append(name[pair % max(len(name), 1)])
                rest[1].append(n)
            at = np.concatenate([[0], np.cumsum(length)])
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(total), nt.lists(nt.as_long(cat(rest[0], nt.U64)), at, pa.int64()), nt.lists(cat(rest[1], np.int64), at, pa.int64())],
                names=[*batch.schema.names[1:], "known_", "hashes_", "times_"],
            )

    named = rows.select(F.col(text_col), *rest)
    kinds = StructType([f for f in named.schema.fields if f.name != text_col])
    kinds = kinds.add("known_", LongType()).add("hashes_", ArrayType(LongType())).add("times_", ArrayType(LongType()))
    # numbered where it is written, so that a row has one number in all that reads it
    base = cut(named.mapInArrow(nt.tidy(count), kinds).withColumn("row_", F.monotonically_increasing_id()))
    tail = base.select("row_", F.explode(F.arrays_zip("hashes_", "times_")).alias("x")).select("row_", F.col("x.hashes_").alias("hash"), F.col("x.times_").alias("times"))
    tail = tail.join(table.select("hash", "pieces"), "hash").groupBy("row_").agg(F.sum(F.col("times") * F.col("pieces")).alias("more_"))
    slim = base.drop("hashes_", "times_").join(tail, "row_", "left")
    return cut(slim.select(*rest, (F.col("known_") + F.coalesce("more_", F.lit(0))).alias("n_tokens")))


def token_counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", broadcast_entries: int = BROADCAST_ENTRIES
) -> DataFrame:
    """(doc_id, n_tokens)."""
    rows = docs.select(document_key(id_col, text_col).alias("key_"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text_"))
    return row_counts(rows, vocabulary, "text_", broadcast_entries).dropDuplicates(["key_"]).drop("key_")
