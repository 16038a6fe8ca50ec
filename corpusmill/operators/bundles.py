"""Bundles under a token budget.

A bundle is a fold over the ranked documents: one that does not fit is skipped, or
referred to, and the next is tried. The fold needs sizes only, so an array of small
structs per bundle is folded in the JVM; texts are joined when a bundle is written.
Only documents that can enter are ranked, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import documents

SIZES = (2000, 4000, 8000, 16000, 32000, 64000, 128000)
WEIGHTS = {"index": 100.0, "readme": 90.0, "important": 50.0, "importance": 30.0, "recent": 10.0}
FOOTER_TOKENS, REFERENCE_ROOM = 50, 100
#: No entry and no reference has fewer: the marks around title and path alone are longer.
LEAST_TOKENS = 3


def scores(docs: DataFrame, importance: DataFrame | None = None, usage: DataFrame | None = None, weights: Mapping[str, float] | None = None, now: Column | None = None) -> DataFrame:
    """``docs`` with ``score``. ``importance``: (path, importance); ``usage``: (path, usage).

    Recency counts only where ``now`` is given and ``docs`` has ``mtime``.
    """
    w = WEIGHTS | dict(weights or {})
    path = F.lower("path")
    name = paths.basename(path)
    score = F.when(name.rlike(r"\Aindex\.(md|mdx|html)\z"), w["index"]).otherwise(0.0) + F.when(name.rlike(r"\Areadme\.(md|mdx|html)\z"), w["readme"]).otherwise(0.0)
    score = score + F.when(documents.contains_any(path, documents.IMPORTANT_IN_BUNDLES), w["important"]).otherwise(0.0)
    score = score + F.when(F.instr("path", "/") == 0, 5.0).otherwise(0.0) - F.when(F.length("content") > 10000, 10.0).otherwise(0.0)
    if now is not None and "mtime" in docs.columns:
        days = (now.cast("double") - F.col("mtime").cast("double")) / 86400
        score = score + F.when(days < 30, w["recent"] * (1 - days / 30)).otherwise(0.0)
    if importance is not None:
        docs = docs.join(importance.select("path", "importance"), "path", "left")
        score = score + F.coalesce("importance", F.lit(0)) * w["importance"]
    if usage is not None:
        docs = docs.join(usage.select("path", "usage"), "path", "left")
        score = score + F.coalesce("usage", F.lit(0.0))
    return docs.withColumn("score", score)


def header(title: str, description: str, instructions: str | None = None) -> str:
    """P12."""
    return f"# {title}\n\n> {description}\n\n" + (f"{instructions}\n\n" if instructions else "")


def _title(docs: DataFrame) -> Column:
    return F.coalesce(F.col("title"), paths.title(F.col("path"))) if "title" in docs.columns else paths.title(F.col("path"))


def entry(title: Column, path: Column, content: Column) -> Column:
    """A whole document."""
    return F.concat(F.lit("## "), title, F.lit("\n*Source: "), path, F.lit("*\n\n"), F.coalesce(content, F.lit("")), F.lit("\n\n---\n\n"))


def reference(title: Column, path: Column, notes: Column, base: str = "") -> Column:
    """A link to a document."""
    return F.concat(F.lit("- ["), title, F.lit("](" + base), path, F.lit(")"), F.when(notes != "", F.concat(F.lit(": "), notes)).otherwise(""), F.lit("\n"))


def sized(scored: DataFrame, base: str = "") -> DataFrame:
    """(path, score, entry_tokens, reference_tokens)."""
    notes = F.coalesce(F.col("description"), F.lit("")) if "description" in scored.columns else F.lit("")
    title, path = _title(scored), F.col("path")
    return scored.select("path", "score", text.tokens(entry(title, path, F.col("content"))).alias("entry_tokens"), text.tokens(reference(title, path, notes, base)).alias("reference_tokens"))


def candidates(rows: DataFrame, size: int) -> DataFrame:
    """The rows that can enter a bundle of ``size`` tokens; exact, and few however many rows there are.

    While there is room for references every document whose reference is short enters
    one way or the other, at ``LEAST_TOKENS`` or more. So after size / LEAST_TOKENS of
    them only entries smaller than that room can follow, and of each size no more than
    fit into it.
    """
    order = [F.desc("score"), F.asc("path")]
    key = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))
    most = size // LEAST_TOKENS + 1
    first = rows.where(F.col("reference_tokens") <= REFERENCE_ROOM).orderBy(*order).limit(most)
    bound = first.agg(F.when(F.count("*") == most, F.max(key)).alias("bound"))
    placed = rows.crossJoin(F.broadcast(bound)).withColumn("late", F.coalesce(key > F.col("bound"), F.lit(False))).drop("bound")
    nth = F.row_number().over(Window.partitionBy("entry_tokens").orderBy(*order))
    late = placed.where(F.col("late") & (F.col("entry_tokens") <= REFERENCE_ROOM)).withColumn("nth", nth).where(F.col("nth") <= REFERENCE_ROOM // LEAST_TOKENS)
    return placed.where("not late").drop("late").unionByName(late.drop("late", "nth"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` by score, ties by path, among the rows given."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def _step(room: int):
    """The fold over ranked documents: state (used, items) and the next document."""

    def step(state: Column, d: Column) -> Column:
        used = state["used"]
        whole = used + d["entry_tokens"] <= room
        referred = ~whole & (used + REFERENCE_ROOM <= room) & (used + d["reference_tokens"] <= room)
        cost = F.when(whole, d["entry_tokens"]).when(referred, d["reference_tokens"]).otherwise(0)
        item = F.struct(d["rank"].alias("rank"), d["path"].alias("path"), F.when(whole, "full").otherwise("ref").alias("kind"), cost.cast("int").alias("tokens"), (used + cost).cast("int").alias("cum_tokens"))
        return F.struct((used + cost).cast("int").alias("used"), F.when(whole | referred, F.concat(state["items"], F.array(item))).otherwise(state["items"]).alias("items"))

    return step


def bundles(scored: DataFrame, sizes: Sequence[int] = SIZES, header_tokens: int = 0, base: str = "") -> DataFrame:
    """(size, rank, path, kind, tokens, cum_tokens) of what each bundle holds.

    ``kind`` is ``full`` or ``ref``. The header counts twice: once as content and once
    off the room, as does the reserve for a footer. ``rank`` is among the documents
    that can enter one of the bundles, see ``candidates``.
    """
    own = F.array_sort(F.collect_list(F.struct("rank", "path", "entry_tokens", "reference_tokens"))).alias("docs")
    all_ = ranked(candidates(sized(scored, base), max(sizes, default=0))).agg(own)
    zero = F.struct(F.lit(header_tokens).alias("used"), F.array().cast("array<struct<rank:int,path:string,kind:string,tokens:int,cum_tokens:int>>").alias("items"))
    fold = lambda size: F.aggregate("docs", zero, _step(size - header_tokens - FOOTER_TOKENS))["items"].alias("items")
    folded = [F.struct(F.lit(size).alias("size"), fold(size)) for size in sizes]
    rows = all_.select(F.explode(F.array(*folded)).alias("b")).select("b.size", F.explode("b.items").alias("i"))
    return rows.select("size", "i.*")


def summary(found: DataFrame, total_documents: DataFrame) -> DataFrame:
    """Per size what is in it. ``total_documents``: one row (total)."""
    full = F.col("kind") == "full"
    own = found.groupBy("size").agg(F.count_if(full).alias("document_count"), F.max("cum_tokens").alias("actual_tokens"), F.array_sort(F.collect_set(F.when(full, paths.section(F.col("path"))))).alias("sections"))
    return own.crossJoin(F.broadcast(total_documents)).select("size", "document_count", "actual_tokens", "sections", F.col("total").alias("total_documents"))


def rendered(found: DataFrame, docs: DataFrame, head: str, total: int, base: str = "") -> DataFrame:
    """K9: (size, text) of each bundle, with a notice of what was left out."""
    notes = F.coalesce(F.col("description"), F.lit("")) if "description" in docs.columns else F.lit("")
    parts = docs.select("path", entry(_title(docs), F.col("path"), F.col("content")).alias("full"), reference(_title(docs), F.col("path"), notes, base).alias("ref"))
    rows = found.join(parts, "path").select("size", "kind", F.struct("rank", F.when(F.col("kind") == "full", F.col("full")).otherwise(F.col("ref")).alias("s")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
    left = F.lit(total) - F.count_if(F.col("kind") == "full")
    notice = F.when(left > 0, F.concat(F.lit("\n---\n*Context truncated: "), left.cast("string"), F.lit(" more documents exist.*\n"))).otherwise("")
    return rows.groupBy("size").agg(F.concat(F.lit(head), body, notice).alias("text"))
