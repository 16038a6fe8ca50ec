"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1 over a budget of tokens. Each source has a weight
schedule, piecewise linear in time; at every time the weights are scaled to sum 1
at the knots. The integral of a source's weight is its cumulative token demand
D(t). Within a source documents are shuffled by a hash of their id; a document that
starts at cumulative token c gets the training position t with D(t) = c. A source
whose demand exceeds its supply starts another epoch; documents beyond D(1) are not
placed. The result is sorted by position.

Plan
    Tokens are those of a byte-level BPE, counted by ``tokencount.row_counts``. One pass
    sums them per (source, bucket), a bucket being a prefix of the hash order. Sums over buckets give each bucket's start, so that no window ever holds
    a whole source, however hot. Positions are close to uniform in tokens, which
    makes the final range partitioning a computed number, without a sampling job.

Defined results
    null or empty text: no tokens, not placed. Null source: a source of its own. A
    source that a given schedule leaves out: not placed. Over ``MOST_SOURCES`` sources:
    an error, as their schedules are worked out on the driver.
    Null id: placed, ordered like the empty id. Ties (same id): by token count, then
    a hash of the text. Repeated rows: each is placed. Empty table: no rows. Other
    columns are carried through untouched by ``mix`` and not read by ``positions``.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpusmill.llm.tokencount import VOCABULARY, row_counts
from corpusmill.session import cut

BUCKETS = 4096
MOST_SOURCES = 100_000
Knots = Sequence[tuple[float, float]]


def tempered(supply: Mapping[str | None, float], start: float = 1.0, end: float = 0.5) -> dict[str | None, Knots]:
    """From shares raised to the power ``start`` at time 0 to ``end`` at time 1."""
    total = float(sum(supply.values()))
    low = sum((v / total) ** start for v in supply.values())
    high = sum((v / total) ** end for v in supply.values())
    return {k: ((0.0, (v / total) ** start / low), (1.0, (v / total) ** end / high)) for k, v in supply.items()}


@dataclass(frozen=True)
class Demand:
    """A source's knots: times, scaled weights, and the integral of the weight up to each."""

    times: tuple[float, ...]
    weights: tuple[float, ...]
    integrals: tuple[float, ...]


def _at(knots: Knots, t: float) -> float:
    times = [x for x, _ in knots]
    i = bisect.bisect_right(times, t)
    if i == 0 or i == len(knots):
        return knots[min(i, len(knots) - 1)][1]
    (a, v), (b, w) = knots[i - 1], knots[i]
    return v + (w - v) * (t - a) / (b - a)


def demands(schedule: Mapping[str | None, Knots]) -> dict[str | None, Demand]:
    """All sources on common knots, with weights scaled to sum 1 at each of them."""
    times = sorted({0.0, 1.0, *(t for knots in schedule.values() for t, _ in knots if 0 < t < 1)})
    if any(w < 0 for knots in schedule.values() for _, w in knots) or any(not knots for knots in schedule.values()):
        raise ValueError("every source needs knots, and no weight may be negative")
    raw = {s: [_at(sorted(knots), t) for t in times] for s, knots in schedule.items()}
    total = [sum(w[i] for w in raw.values()) for i in range(len(times))]
    if raw and min(total) <= 0:
        raise ValueError("the weights sum to 0 at a knot")
    out = {}
    for source, weights in raw.items():
        scaled = [w / x for w, x in zip(weights, total)]
        integral = [0.0]
        for i in range(1, len(times)):
            integral.append(integral[-1] + (times[i] - times[i - 1]) * (scaled[i] + scaled[i - 1]) / 2)
        out[source] = Demand(tuple(times), tuple(scaled), tuple(integral))
    return out


def inverse(x: Column) -> Column:
    """The time at which the integral (columns times, weights, integrals) reaches ``x``."""
    last = F.size("integrals")
    k = F.least(F.greatest(F.size(F.filter("integrals", lambda c: c <= x)), F.lit(1)), last - 1)
    at = lambda name, i: F.element_at(name, i)
    span = at("times", k + 1) - at("times", k)
    a, b = at("weights", k), (at("weights", k + 1) - at("weights", k)) / span
    y = x - at("integrals", k)
    root = F.sqrt(F.greatest(a * a + 2 * b * y, F.lit(0.0)))
    return at("times", k) + F.when(y > 0, 2 * y / (a + root)).otherwise(0.0)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str | None, keep: list[Column]) -> DataFrame:
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slim = docs.select(
        F.col(source_col).cast("string").alias("__source"), F.col(id_col).alias("__id"), h.alias("__h"), F.col(text_col).alias("__text_"), F.xxhash64(text_col).alias("__text"), *keep
    )
    rows = row_counts(slim, vocabulary, "__text_").withColumnRenamed("n_tokens", "__tokens").where("__tokens > 0")
    bucket = F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") * BUCKETS, 32).cast("int")
    return rows.withColumn("__bucket", bucket)


def _placed(rows: DataFrame, schedule, budget: int | None) -> DataFrame:
    """``rows`` with __epoch and __position."""
    spark = rows.sparkSession
    sums = cut(rows.groupBy("__source", "__bucket").agg(F.sum("__tokens").alias("sum")))
    supply = {r[0]: int(r[1]) for r in sums.groupBy("__source").agg(F.sum("sum")).limit(MOST_SOURCES + 1).collect()}
    if len(supply) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    total = int(sum(supply.values()) if budget is None else budget)
    if total <= 0 and budget is not None:
        raise ValueError("the budget must be 1 token at least")
    want = demands(schedule(supply) if callable(schedule) else {s: k for s, k in schedule.items() if s in supply}) if supply else {}
    table = spark.createDataFrame(
        [Row(s, float(supply[s]), list(d.times), list(d.weights), list(d.integrals)) for s, d in want.items()],
        "src string, supply double, times array<double>, weights array<double>, integrals array<double>",
    )
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    starts = starts.join(F.broadcast(table), F.col("__source").eqNullSafe(F.col("src"))).drop("src")
    starts = starts.select(F.col("__source").alias("s_"), F.col("__bucket").alias("b_"), "start", "supply", "times", "weights", "integrals")
    inside = Window.partitionBy("s_", "b_").orderBy("__h", "__id", "__tokens", "__text").rowsBetween(Window.unboundedPreceding, -1)
    # the join and the window share one partitioning; the null source joins as a key of its own
    key = lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit(""))
    left = rows.withColumn("k_", key(F.col("__source"))).drop("__source")
    right = starts.withColumn("k_", key(F.col("s_"))).drop("s_").withColumnRenamed("b_", "__bucket")
    inside = Window.partitionBy("k_", "__bucket").orderBy("__h", "__id", "__tokens", "__text").rowsBetween(Window.unboundedPreceding, -1)
    at = left.join(right, ["k_", "__bucket"]).withColumn("at_", (F.col("start") + F.coalesce(F.sum("__tokens").over(inside), F.lit(0))).cast("double"))
    demand = F.element_at("integrals", -1) * F.lit(float(total))
    epochs = F.ceil((demand - F.col("at_")) / F.col("supply"))
    at = at.where(F.col("at_") < demand).withColumn("__epoch", F.explode(F.sequence(F.lit(0), (F.greatest(epochs, F.lit(1)) - 1).cast("int"))))
    at = at.withColumn("reached", F.col("at_") + F.col("__epoch") * F.col("supply")).where(F.col("reached") < demand)
    at = at.withColumn("__position", F.least(inverse(F.col("reached") / F.lit(float(total))), F.lit(1.0)))
    return at.withColumn("__source", F.when(F.col("k_") != "", F.substring("k_", 2, 1 << 30)))


def _sorted(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__part", F.least(F.floor(F.col("__position") * parts), F.lit(parts - 1)).cast("int"))
    return ranged.repartitionById(parts, F.col("__part")).sortWithinPartitions("__position", "__source", "__h", "__id", "__epoch", "__tokens", "__text")


def positions(
    docs: DataFrame, schedule=tempered, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = VOCABULARY
) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, position), sorted by position.

    ``schedule``: knots (time, weight) by source, or a function of the sources'
    supplies that returns them; a source that it leaves out has weight 0 and is not
    placed. ``budget``: tokens of the whole curriculum; all tokens of the table where
    it is not given. Without a vocabulary, words are counted.
    """
    placed = _sorted(_placed(_keyed(docs, id_col, text_col, source_col, vocabulary, []), schedule, budget))
    return placed.select(
        F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__epoch").alias("epoch"),
        F.col("__tokens").alias("n_tokens"), F.round("__position", 9).alias("position"),
    )


def mix(
    docs: DataFrame, schedule=tempered, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = VOCABULARY
) -> DataFrame:
    """The rows of ``docs``, with their columns, as often and in the order that the curriculum places them.

    Rows are placed without their texts, by their file and row; a table that is no file is
    written first. Texts move to their places, and then in order.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs)
    row = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    placed = _placed(_keyed(docs, id_col, text_col, source_col, vocabulary, [row.alias("__row")]), schedule, budget).drop("__bucket", "k_", "start", "supply", "times", "weights", "integrals")
    whole = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), row.alias("__row"))
    return _sorted(whole.join(placed, "__row")).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
