"""The link graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.session import cut, drop_cut

#: Up to so many edges (with their nodes) the ranks are computed by one task.
ONE_TASK_EDGES = 2_000_000


def degrees(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, in_links, out_links); links within one document count on both sides."""
    inside = edges.where("type <> 'external'")
    ends = inside.select(F.explode(F.array(F.struct(F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    count = ends.select("x.*").groupBy("path").agg(F.sum("i").alias("in_links"), F.sum("o").alias("out_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("path").distinct().join(count, "path", "left").select("path", zero("in_links"), zero("out_links"))


def ranks(docs: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(path, score) after ``rounds`` of rank propagation from 1/N.

    Each link of a document passes on its share; the rank of a document without links
    is lost, as the definition asks. A graph of at most ``ONE_TASK_EDGES`` links is
    summed by one task; a larger one by joins, cut every four rounds.
    """
    damping = damping or 0.85
    nodes = docs.select("path").distinct()
    links = edges.where("type <> 'external'").select("source", "target")
    weights = links.groupBy("source", "target").count().join(links.groupBy("source").count().withColumnRenamed("count", "out"), "source")
    shares = weights.join(nodes.withColumnRenamed("path", "target"), "target", "left_semi").select("source", "target", (F.col("count") / F.col("out")).alias("share"))
    # written once: the links, and each document as a link from nowhere
    rows = cut(shares.unionByName(nodes.select(F.lit(None).cast("string").alias("source"), F.col("path").alias("target"), F.lit(0.0).alias("share"))))
    n, links_ = rows.agg(F.count_if(F.col("source").isNull()), F.count("source")).first()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    if n + links_ <= ONE_TASK_EDGES:
        return _ranks_of_one(rows, damping, rounds)
    held, shares = rows.where("source is null").select(F.col("target").alias("path")), rows.where("source is not null")
    scores = held.withColumn("score", F.lit(1.0 / n))
    kept: DataFrame | None = None
    for i in range(rounds):
        passed = shares.join(scores, F.col("source") == F.col("path")).groupBy("target").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        fresh = held.join(passed, F.col("path") == F.col("target"), "left").select("path", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 4 == 3:
            scores = cut(fresh)
            if kept is not None:
                drop_cut(kept)
            kept = scores
        else:
            scores = fresh
    return scores


def _ranks_of_one(rows: DataFrame, damping: float, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        source, target, share = (pa.concat_arrays([b.column(i) for b in table]) for i in range(3))
        names = target.unique()
        names = names.take(pa.compute.sort_indices(names))
        at = pa.compute.index_in(source, names).to_numpy(zero_copy_only=False)
        is_edge = ~np.isnan(at.astype(float))
        s, t = at[is_edge].astype(np.int64), pa.compute.index_in(target, names).to_numpy()[is_edge]
        w, n = share.to_numpy()[is_edge], len(names)
        order = np.lexsort((s, t))  # sums in one order, whatever the partitioning was
        s, t, w = s[order], t[order], w[order]
        score = np.full(n, 1.0 / n)
        for _ in range(rounds):
            score = (1 - damping) / n + damping * np.bincount(t, score[s] * w, n)
        yield pa.RecordBatch.from_arrays([names, pa.array(score)], names=["path", "score"])

    return rows.coalesce(1).mapInArrow(run, "path string, score double")


def importance(scores: DataFrame) -> DataFrame:
    """A3: (path, importance): scores scaled to 0..100 between their least and largest, halves up."""
    bounds = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    return scores.crossJoin(F.broadcast(bounds)).select("path", F.floor((F.col("score") - F.col("low")) / span * 100 + 0.5).cast("int").alias("importance"))


def nodes(docs: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(path, title, section, in_links, out_links, importance, word_count)."""
    title = F.coalesce(F.col("title"), paths.title(F.col("path"))) if "title" in docs.columns else paths.title(F.col("path"))
    base = docs.select("path", title.alias("title"), paths.section(F.col("path"), "root").alias("section"), text.words_split(F.coalesce("content", F.lit(""))).alias("word_count"))
    found = base.join(degrees(docs, edges), "path").join(importance(ranks(docs, edges, damping, rounds)), "path")
    return found.select("path", "title", "section", "in_links", "out_links", "importance", "word_count")


def hubs(nodes_: DataFrame, least: int = 5, k: int = 10) -> DataFrame:
    """The k documents with most links out, of those with ``least`` or more; ties by path."""
    return nodes_.where(F.col("out_links") >= least).select("path", "out_links").orderBy(F.desc("out_links"), "path").limit(k)


def authorities(nodes_: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """O6."""
    return nodes_.where(F.col("in_links") >= least).select("path", "in_links").orderBy(F.desc("in_links"), "path").limit(k)


def most_important(nodes_: DataFrame, k: int = 10) -> DataFrame:
    """O6."""
    return nodes_.select("path", "importance").orderBy(F.desc("importance"), "path").limit(k)


def orphans(nodes_: DataFrame) -> DataFrame:
    """A2: documents without any link, in or out."""
    return nodes_.where("in_links = 0 and out_links = 0").select("path")


def analysis(nodes_: DataFrame) -> DataFrame:
    """A2: one row of totals."""
    lone = (F.col("in_links") == 0) & (F.col("out_links") == 0)
    edges = F.coalesce(F.sum("out_links"), F.lit(0))
    return nodes_.agg(
        F.count("*").alias("total_nodes"), edges.alias("total_edges"), F.when(F.count("*") > 0, F.round(edges / F.count("*"), 6)).otherwise(0.0).alias("average_links_per_doc"),
        F.count_if(F.col("out_links") >= 5).alias("hubs"), F.count_if(F.col("in_links") >= 3).alias("authorities"), F.count_if(lone).alias("isolated_count"),
    )


def headings(docs: DataFrame) -> DataFrame:
    """(path, pos, line, level, title, anchor, parent_anchor).

    W6: the parent is the nearest heading above of a lower level. It is found within
    the document's own array, in one pass, so that nothing shuffles.
    """
    title = lambda c: F.trim(F.regexp_extract(c, r"\A#{1,6}\s+(.+)\z", 1), F.lit(" \t\r\f\x0b"))
    rows = F.transform(F.split("content", "\n", -1), lambda l, i: F.struct(l.alias("l"), (i + 1).alias("line")))
    rows = F.filter(rows, lambda x: x["l"].rlike(r"\A#{1,6}\s+.+\z"))
    rows = F.transform(rows, lambda x: F.struct(x["l"].alias("l"), x["line"].alias("line"), F.length(F.regexp_extract(x["l"], r"\A(#{1,6})\s", 1)).alias("level")))
    found = docs.select("path", rows.alias("found")).where(F.size("found") > 0)
    out = found.mapInArrow(_with_parents, "path string, pos int, line int, level int, l string, up string")
    return out.select("path", "pos", "line", "level", title("l").alias("title"), paths.anchor(title("l")).alias("anchor"), F.when(F.col("up").isNotNull(), paths.anchor(title("up"))).alias("parent_anchor"))


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over each document's headings: the last heading of every level is known."""
    for batch in batches:
        found = batch.column(1)
        off = found.offsets.to_numpy()
        off = off - off[0]
        text, line, level = (found.flatten().field(i) for i in range(3))
        texts, levels, up, pos = text.to_pylist(), level.to_pylist(), [None] * len(text), np.zeros(len(text), np.int32)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            last = [-1] * 7
            pos[a:b] = np.arange(b - a)
            for i in range(a, b):
                above = max(last[: levels[i]])
                if above >= 0:
                    up[i] = texts[above]
                last[levels[i]] = i
        path = batch.column(0).take(pa.array(np.repeat(np.arange(len(off) - 1), np.diff(off))))
        yield pa.RecordBatch.from_arrays([path, pa.array(pos), line.cast(pa.int32()), level.cast(pa.int32()), text, pa.array(up, pa.string())], names=["path", "pos", "line", "level", "l", "up"])


def section_edges(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, type): links to a section, and headings to those below them."""
    node = lambda c: F.concat("path", F.lit("#"), c)
    down = headings(docs).where("parent_anchor is not null").select(node("parent_anchor").alias("source"), node("anchor").alias("target"), F.lit("parent-child").alias("type"))
    to = edges.where("type <> 'external' and anchor is not null and anchor <> ''")
    return to.select("source", F.concat("target", F.lit("#"), "anchor").alias("target"), F.lit("section-reference").alias("type")).unionByName(down)


def section_nodes(docs: DataFrame) -> DataFrame:
    """T4: (id, doc_path, title, level, anchor)."""
    return headings(docs).select(F.concat("path", F.lit("#"), "anchor").alias("id"), F.col("path").alias("doc_path"), "title", "level", "anchor")
