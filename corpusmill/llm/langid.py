"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, one row per label and one column per
hash bucket, fitted on a bounded sample of labelled rows and broadcast. A batch
of texts is scored in numpy: the bucket of every n-gram is gathered from the
matrix and summed per text. Scoring is a map over the table; nothing shuffles.

Only letters tell a language: the text is lower-cased and every run of other ASCII
characters counts as one blank, so that numbers, addresses and keys in a short text do
not hide its language.

Beside the labels there is a class ``und`` that gives every bucket the same
probability. A text that ``und`` explains best looks like none of the languages.

Defined results
    null or empty text, or text without two letters in a row (a blank after a word
    counts as one): predicted null, not accepted.
    Ties between labels: the alphabetically first. Repeated rows: each is scored.
    Null labels: not used for fitting. No labelled row at all: every text is
    predicted ``und`` and accepted by none. Over ``MOST_LABELS`` labels: an error, as
    the matrix has a row for each. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm import numtext as nt
from corpusmill.session import Shared

UND = "und"
MOST_LABELS = 256


@dataclass(frozen=True)
class LangModel:
    labels: tuple[str, ...]
    orders: tuple[int, ...]
    logp: np.ndarray  # (labels + 1, buckets), the last row is UND


def char_codes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One integer per character (its UTF-8 bytes), and the texts' offsets in characters."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    more = np.concatenate([~lead, np.zeros(3, bool)])
    code, going = wide[at], np.ones(len(at), bool)
    if len(at) < len(buf):
        for k in (1, 2, 3):
            going = going & more[at + k]
            code |= np.where(going, wide[at + k] << np.uint32(8 * k), np.uint32(0))
    return code, np.searchsorted(at, off)


def letters(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of characters that are no letters as one blank, none at the start of a text."""
    blank = (code < 128) & ~((code >= 97) & (code <= 122))
    after = np.zeros(len(code) + 1, bool)
    after[1:] = blank
    after[off] = True
    keep = ~(blank & after[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(blank, np.uint32(32), code)[keep], at[off]


def grams_of(texts: pa.Array, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Row range, and per order the buckets and offsets of its texts' n-grams."""
    buf, off = nt.flat(pc.utf8_lower(pc.fill_null(texts, "")))
    for a, b in nt.slices(off):
        code, at = letters(*char_codes(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
        yield a, b, [buckets_of(code, at, o, buckets) for o in orders]


def buckets_of(code: np.ndarray, off: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each text's n-grams of one order, and their offsets."""
    total = max(0, len(code) - order + 1)
    h = np.full(total, (0x811C9DC5 * order) & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ code[k : k + total]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    count = np.maximum(np.diff(off) - order + 1, 0)
    if order > 1 and total:  # n-grams that reach over the edge of a text go
        inside = np.zeros(len(code) + 1, np.int32)
        np.add.at(inside, off[:-1], 1)
        np.add.at(inside, off[:-1] + count, -1)
        h = h[np.cumsum(inside[:-1])[:total] > 0]
    return h % np.uint32(buckets), np.concatenate([[0], np.cumsum(count)])


def score_texts(texts: pa.Array, model: LangModel) -> tuple[np.ndarray, np.ndarray]:
    """Per text the summed log-probability under each class, and the n-gram count."""
    n, classes = len(texts), len(model.logp)
    score, grams = np.zeros((n, classes)), np.zeros(n, np.int64)
    for a, b, found in grams_of(texts, model.orders, model.logp.shape[1]):
        for bucket, where in found:
            some = np.flatnonzero(np.diff(where))
            if len(some):
                for c in range(classes):
                    score[a + some, c] += np.add.reduceat(model.logp[c][bucket], where[some], dtype=np.float64)
            grams[a:b] += np.diff(where)
    return score, grams


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    rows_per_label: int = 2000,
    buckets: int = 1 << 16,
    orders: tuple[int, ...] = (2, 3),
    alpha: float = 0.1,
) -> LangModel:
    """Fit on at most ``rows_per_label`` rows of each label (a hash of the id chooses).

    The sample bounds what the driver receives: one count per label and bucket.
    """
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("bigint")
    key = docs.select(F.col(id_col).alias("id_"), F.col(label_col).cast("string").alias("label_"), h.alias("h_")).where(F.col("label_").isNotNull() & F.col("id_").isNotNull())
    # a label's first rows have hashes under a bound that its count gives, so that only some of a label's rows meet
    many = key.groupBy("label_").agg(F.least(F.lit(1.0), (rows_per_label + 10 * math.sqrt(rows_per_label)) / F.count("*")).alias("share_"))
    few = key.join(F.broadcast(many.limit(MOST_LABELS + 1)), "label_").where(F.col("h_") <= F.col("share_") * (1 << 48))
    order = Window.partitionBy("label_").orderBy("h_", "id_")
    chosen = few.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= rows_per_label)
    labels = tuple(sorted(r[0] for r in chosen.select("label_").distinct().limit(MOST_LABELS + 1).collect()))
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{label_col} has over {MOST_LABELS} values")
    index = {label: i for i, label in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), buckets), np.int64)
        for batch in batches:
            which = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, found in grams_of(batch.column(1), orders, buckets):
                for bucket, where in found:
                    row = np.repeat(which[a:b], np.diff(where))
                    total += np.bincount(row * buckets + bucket, minlength=total.size).reshape(total.shape)
        row, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(total[row, column])], names=["l_", "b_", "c_"])

    counts = np.zeros((len(labels), buckets))
    if labels:
        sample = docs.select(F.col(id_col).alias("id_"), F.col(label_col).cast("string").alias("label_"), F.col(text_col).alias("text_"))
        sample = sample.join(F.broadcast(chosen.select("id_", "label_")), ["id_", "label_"], "left_semi")
        parts = sample.select("label_", "text_").mapInArrow(nt.tidy(count), "l_ long, b_ long, c_ long")
        table = parts.groupBy("l_", "b_").agg(F.sum("c_").alias("c_")).toArrow()
        counts[table["l_"].to_numpy(), table["b_"].to_numpy()] = table["c_"].to_numpy()
    logp = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * buckets)
    logp = np.vstack([logp, np.full((1, buckets), -np.log(buckets))]).astype(np.float32)
    return LangModel(labels, tuple(orders), logp)


def decide(texts: pa.Array, model: LangModel) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Predicted label, margin per n-gram over the next class, and acceptance."""
    score, grams = score_texts(texts, model)
    best = score.argmax(1)
    rest = score.copy()
    rest[np.arange(len(best)), best] = -np.inf
    some = grams > 0
    margin = np.zeros(len(best))
    if score.shape[1] > 1:
        margin = np.round((score.max(1, initial=-np.inf) - rest.max(1, initial=-np.inf)) / np.maximum(grams, 1), 4)
    names = np.array([*model.labels, UND], object)[best]
    names[~some] = None
    accepted = some & (best < len(model.labels))
    return pa.array(names, pa.string()), pa.array(margin, pa.float64(), mask=~some), accepted


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, predicted, margin, accepted."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, margin, accepted = decide(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), name, margin, pa.array(accepted)], names=[id_col, "predicted", "margin", "accepted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text_")).mapInArrow(nt.tidy(run), f"`{id_col}` {kind}, predicted string, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in one of the model's languages."""
    shared = Shared(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at), shared.value)[2]))

    return docs.mapInArrow(nt.tidy(run), docs.schema)
