"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bounded-space online best-fit: a packer holds at most ``open_bins`` open bins, in a
bitset with one bit per free space. A piece goes into the open bin that it leaves
fullest: the lowest set bit at or above its size. If none has room, a new bin is
opened; were that one too many, the fullest open bin closes first. A document longer
than a sequence is cut into full pieces, each a bin of its own, and a rest.

Plan
    Tokens are those of a byte-level BPE, counted by ``tokencount.row_counts`` (or words,
    without a vocabulary). Only (id, token count) is shuffled, never a text. Documents go by
    a hash of the id to shards of about ``shard_tokens`` tokens; the number of shards follows from
    the table and not from the cluster, so that the result is the same on any. Each
    shard is packed in order of id by one task, row by row, in constant memory.
    With ``in_order`` documents keep the order of the table: running sums of tokens
    over its parts give the place of each, shards are contiguous ranges of about
    ``shard_tokens`` tokens, and each is packed in that order. The order of Parquet
    files that are read as they are is by file and row; of any other plan, by
    partition and row.

Defined results
    null or empty text: no tokens, in no bin. Null id: packed, last of its shard.
    Ties (same id): by token count. Repeated rows: each is packed. Empty table: no
    rows. Ids are integers, or what casts to bigint. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokencount import VOCABULARY, row_counts
from corpusmill.session import cut

CAPACITY, OPEN_BINS, SHARD_TOKENS = 2048, 64, 8 << 20


class Packer:
    """Online best-fit with a bounded number of open bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open bins must be 1 at least")
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f: an open bin has f free
        self.by_free: dict[int, list[tuple[int, int]]] = {}  # free -> (bin, slots)
        self.open = self.bins = 0

    def _take(self, free: int) -> tuple[int, int]:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return got

    def _put(self, free: int, which: int, slots: int) -> None:
        if free:  # a full bin is closed
            self.by_free.setdefault(free, []).append((which, slots))
            self.bits |= 1 << free
            self.open += 1

    def add(self, size: int) -> tuple[int, int, int]:
        """(bin, slot in the bin, offset in the bin) of a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            which, slots = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, which, slots = self.capacity, self.bins, 0
            self.bins += 1
        self._put(free - size, which, slots + 1)
        return which, slots, self.capacity - free


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> list[tuple[int, int, int, int, int]]:
    """(row, start in the document, tokens, bin, offset in the bin) of every piece, in order."""
    packer, out = Packer(capacity, open_bins), []
    for row, size in enumerate(sizes):
        out += [(row, *x) for x in _pieces(packer, size)]
    return out


def _pieces(packer: Packer, size: int) -> Iterator[tuple[int, int, int, int]]:
    start = 0
    while start < size:
        n = min(packer.capacity, size - start)
        which, _, offset = packer.add(n)
        yield start, n, which, offset
        start += n


def _arrival(docs: DataFrame) -> list[Column]:
    """Which part of the table a row stands in (number, name), and where in it."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        # files are read in splits and not in their order
        name = F.col("_metadata.file_name")
        number = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as bigint)"), F.lit(0).cast("bigint"))
        return [number.alias("part"), name.alias("name"), F.col("_metadata.row_index").alias("at")]
    place = F.monotonically_increasing_id()
    return [F.shiftright(place, 33).alias("part"), F.lit("").alias("name"), place.alias("at")]


def _before(rows: DataFrame) -> DataFrame:
    """``rows`` with the tokens that stand before each in the table."""
    inside = Window.partitionBy("part", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part of the table
    ahead = Window.orderBy("part", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(rows.groupBy("part", "name").agg(F.sum("n").alias("sum"))).withColumn("first", F.coalesce(F.sum("sum").over(ahead), F.lit(0))).drop("sum")
    found = rows.join(F.broadcast(starts), ["part", "name"])
    return found.withColumn("before", F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0)))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text",
    in_order: bool = False, vocabulary: str | None = VOCABULARY,
) -> DataFrame:
    """(shard, bin, offset, doc_id, start, n_tokens): the place of each piece of each document."""
    spark = docs.sparkSession
    place = _arrival(docs) if in_order else []
    rows = row_counts(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text_"), *place), vocabulary, "text_")
    rows = rows.where("n_tokens > 0").withColumnRenamed("n_tokens", "n")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if in_order:
        rows = _before(rows).withColumn("shard", F.floor(F.col("before") / shard_tokens).cast("int"))
    else:
        h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")
        rows = rows.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int"))
    order = ["before"] if in_order else [F.asc_nulls_last("doc_id"), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shard = Packer(capacity, open_bins), None
        for batch in batches:
            of, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple[int, int, int, int]] = []
            row: list[int] = []
            for i, (s, n) in enumerate(zip(of, sizes)):
                if s != shard:
                    packer, shard = Packer(capacity, open_bins), s
                before = len(out)
                out += _pieces(packer, n)
                row += [i] * (len(out) - before)
            start, n, which, offset = np.array(out, np.int64).reshape(-1, 4).T
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(which), pa.array(offset), batch.column(1).take(at), pa.array(start), pa.array(n)],
                names=["shard", "bin", "offset", "doc_id", "start", "n_tokens"],
            )

    placed = rows.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", *order)
    return placed.select("shard", "doc_id", "n").mapInArrow(run, "shard int, bin bigint, offset bigint, doc_id bigint, start bigint, n_tokens bigint")
