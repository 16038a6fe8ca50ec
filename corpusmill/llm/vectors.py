"""What the searches over vectors share: sound rows, exact distances, and merging of top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "q bigint, n bigint, d double"


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None) -> tuple[DataFrame, int]:
    """(id, vec, asks) without what is no vector; and the dimension.

    The dimension is the length that most rows have (of ties the larger). Rows with a
    null id, a null vector, another length, or an element that is null or not finite
    are left out. ``asks``: whether ``queries`` holds; true where it is not given.
    """
    vec = F.col(vec_col).cast("array<float>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    sound = rows.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), asks.alias("asks")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0))
    most = sound.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = most[0] if most else 1
    return sound.where(F.size("vec") == dim), dim


def tagged(rows: DataFrame, k: int, queries: Column | None, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec, asks): data once, without equal vectors that cannot be neighbours, and the queries; and the dimension."""
    sound, dim = fit(rows, id_col, vec_col, queries)
    # the limit of a rank is applied before the shuffle as well, so that a hot vector is k + 1 rows a task
    least = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    data = sound.select("id", "vec").withColumn("at", least).where(F.col("at") <= k + 1).select("id", "vec").distinct()
    return data.withColumn("asks", F.lit(False)).union(sound.where("asks").select("id", "vec").distinct().withColumn("asks", F.lit(True))), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32, copy=False)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by a matrix product in double precision; off by rounding only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


class Best:
    """The k nearest of a block of queries: by distance, then by id."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs.astype(np.float64), k
        self.worst = np.full(len(ids), np.inf)  # squared, of the kth
        self.row, self.other, self.dist = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

    def offer(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Let the queries ``rows`` see the vectors ``ids``; equal ids are the query itself."""
        if not len(rows) or not len(ids):
            return
        vecs = vecs.astype(np.float64)
        step = max(1, (1 << 21) // len(ids))
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
        starts = None if len(starts) == len(ids) else starts
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            d = squares(self.vecs[part], vecs)
            d[self.ids[part][:, None] == ids[None]] = np.inf
            # each id counts once, so the limit is the kth of the ids' nearest
            least = d if starts is None else np.minimum.reduceat(d[:, order], starts, axis=1)
            limit = self.worst[part]
            if least.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(least, self.k - 1, axis=1)[:, self.k - 1])
            # a margin for rounding; what is within it is measured exactly below
            x, y = np.nonzero((d <= (limit * (1 + 1e-9) + 1e-9)[:, None]) & np.isfinite(d))
            if len(x):
                self._merge(part[x], ids[y], exact(self.vecs[part[x]], vecs[y]))

    def _merge(self, row: np.ndarray, other: np.ndarray, dist: np.ndarray) -> None:
        touched = np.zeros(len(self.ids), bool)
        touched[row] = True
        old = touched[self.row]
        row, other, dist = (np.concatenate([a[old], b]) for a, b in ((self.row, row), (self.other, other), (self.dist, dist)))
        order = np.lexsort((dist, other, row))
        row, other, dist = row[order], other[order], dist[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
        row, other, dist = row[new], other[new], dist[new]
        order = np.lexsort((other, dist, row))
        row, other, dist = row[order], other[order], dist[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        last = np.flatnonzero(rank == self.k - 1)
        self.worst[row[last]] = np.minimum(self.worst[row[last]], dist[last])
        keep = rank < self.k
        self.row, self.other, self.dist = (np.concatenate([a[~old], b[keep]]) for a, b in ((self.row, row), (self.other, other), (self.dist, dist)))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.other), pa.array(np.sqrt(self.dist))], names=["q", "n", "d"])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of pairs; the same bits whichever of the two comes first."""
    out = np.zeros(len(a))
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.square(a[i : i + (1 << 16)] - b[i : i + (1 << 16)]).sum(1)
    return out


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): the k first of every query's pairs.

    An id that asks with several vectors has several lists; a neighbour counts once.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nearest = pairs.repartition(parts, "q").groupBy("q", "n").agg(F.min("d").alias("d"))
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "n"))), 1, k)
    top = nearest.groupBy("q").agg(near.alias("near")).select("q", F.posexplode("near").alias("at", "x"))
    return top.select(F.col("q").alias("query_id"), F.col("x.n").alias("neighbor_id"), (F.col("at") + 1).alias("rank"), F.round("x.d", 5).alias("distance"))
