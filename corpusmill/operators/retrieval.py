"""Keyword retrieval and loaders' shapes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text


def top(scored: DataFrame, k: int, key: str = "path") -> DataFrame:
    """The k best rows with a score over 0; ties by ``key``. Spark plans TakeOrderedAndProject."""
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(k)


def doc_index(docs: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(path, title, section, tags, description); titles are made of the path in title case."""
    given = F.col("title") if "title" in docs.columns else F.lit(None).cast("string")
    title = F.coalesce(given, paths.title_case(paths.title(F.col("path"))))
    about = F.coalesce(F.col("description"), F.lit("")) if "description" in docs.columns else F.lit("")
    out = docs.select("path", title.alias("title"), paths.section(F.col("path"), "root").alias("section"), about.alias("description"))
    none = F.array().cast("array<string>")
    return out.join(tagged, "path", "left").withColumn("tags", F.coalesce("tags", none)) if tagged is not None else out.withColumn("tags", none)


def search_docs(index: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """G1: (path, title, section, score): the whole query in title 10, any tag 7, path 5, description 3."""
    q = query.lower()
    hit = lambda c, points: F.when(F.lower(c).contains(q), points).otherwise(0)
    score = hit("title", 10) + hit("path", 5) + hit("description", 3) + F.when(F.exists("tags", lambda t: F.lower(t).contains(q)), 7).otherwise(0)
    return top(index.select("path", "title", "section", score.alias("score")), limit)


def get_document(docs: DataFrame, path: str) -> DataFrame:
    """G2."""
    return docs.where(F.col("path") == path)


def list_documents(index: DataFrame, section: str | None = None, tags: Iterable[str] = ()) -> DataFrame:
    """Of one section, and with any of the tags."""
    out = index if section is None else index.where(F.col("section") == section)
    tags = list(tags)
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def occurrences(content: Column, query: str, regex: bool = False) -> Column:
    """Sum over the query's words of their occurrences; words are literal unless ``regex``."""
    low = F.lower(F.coalesce(content, F.lit("")))
    out = F.lit(0)
    for term in query.lower().split():
        out = out + F.regexp_count(low, F.lit(term if regex else re.sub(r"([\\.^$*+?()\[\]{}|])", r"\\\1", term)))
    return out


def relevant_documents(docs: DataFrame, query: str, k: int = 4, importance: DataFrame | None = None) -> DataFrame:
    """(path, score): 10 per query word in the title and 1 per occurrence, times 1 + importance."""
    title = F.lower(F.coalesce(F.col("title"), paths.title(F.col("path"))) if "title" in docs.columns else paths.title(F.col("path")))
    score = occurrences(F.col("content"), query)
    for term in query.lower().split():
        score = score + F.when(title.contains(term), 10).otherwise(0)
    out = docs.select("path", score.cast("double").alias("score"))
    if importance is not None:
        out = out.join(importance.select("path", "importance"), "path", "left").select("path", (F.col("score") * (1 + F.coalesce("importance", F.lit(0)))).alias("score"))
    return top(out, k)


def index_query(chunks: DataFrame, query: str, k: int = 5, importance: DataFrame | None = None) -> DataFrame:
    """(chunk_id, source_path, score) by occurrences, times 1 + importance of the source."""
    out = chunks.select("chunk_id", "source_path", occurrences(F.col("content"), query).cast("double").alias("score"))
    if importance is not None:
        by = importance.select(F.col("path").alias("source_path"), "importance")
        out = out.join(by, "source_path", "left").select("chunk_id", "source_path", (F.col("score") * (1 + F.coalesce("importance", F.lit(0)))).alias("score"))
    return top(out, k, "chunk_id")


def filter_chunks(chunks: DataFrame, least: int | None = None, most: int | None = None, profiles: Iterable[str] = ()) -> DataFrame:
    """by token count, and by profile where chunks carry one."""
    out = chunks
    if least is not None:
        out = out.where(F.col("token_count") >= least)
    if most is not None:
        out = out.where(F.col("token_count") <= most)
    profiles = list(profiles)
    return out.where(F.col("profile").isin(*profiles)) if profiles and "profile" in chunks.columns else out


def loaded(rows: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), column: str = "path") -> DataFrame:
    """rows whose path matches any of ``include`` (all, if none is given) and none of ``exclude``, which go first."""
    from corpusmill.sources.files import matches_globs

    return rows.where(matches_globs(F.col(column), include, exclude))


def loader_documents(docs: DataFrame, tagged: DataFrame | None = None, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """(page_content, metadata) with path, title, section and tags."""
    docs = loaded(docs, include, exclude)
    rows = doc_index(docs, tagged).join(docs.select("path", "content"), "path")
    meta = F.struct(F.col("path").alias("source"), "title", "section", "tags")
    return rows.select(F.coalesce("content", F.lit("")).alias("page_content"), meta.alias("metadata"))


def loader_chunks(chunks: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """(page_content, metadata) with a citation."""
    chunks = loaded(chunks, include, exclude, "source_path")
    cited = text.citation(F.col("source_path"), F.col("heading_path"), F.col("line_range.start"), F.col("line_range.end"))
    return chunks.select(F.col("content").alias("page_content"), F.struct("chunk_id", F.col("source_path").alias("source"), "token_count", cited.alias("citation")).alias("metadata"))


def nodes(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(node_id, text, source_id, previous_id, next_id, citation); the source is null where the document is gone."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_path").orderBy("chunk_index")
    known = docs.select(F.col("path").alias("source_path"), text.reader_id(F.col("path")).alias("source_id")).distinct()
    cited = text.citation(F.col("source_path"), F.col("heading_path"), F.col("line_range.start"), F.col("line_range.end"))
    return chunks.join(known, "source_path", "left").select(
        F.col("chunk_id").alias("node_id"), F.col("content").alias("text"), "source_id", F.lag("chunk_id").over(order).alias("previous_id"), F.lead("chunk_id").over(order).alias("next_id"), cited.alias("citation")
    )


def hierarchy(index: DataFrame) -> DataFrame:
    """(prefix, depth, documents, paths) for every leading part of a document's directory."""
    parts = F.split(paths.directory(F.col("path")), "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), n.alias("depth"))))
    return index.select("path", prefix.alias("x")).groupBy("x.prefix", "x.depth").agg(F.count("*").alias("documents"), F.array_sort(F.collect_list("path")).alias("paths"))


def summaries(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(parent_doc_id, summary): the manifest's description, or the start of the text."""
    about = manifest.select("path", F.col("id").alias("parent_doc_id"), *(["description"] if "description" in manifest.columns else []))
    given = F.nullif(F.col("description"), F.lit("")) if "description" in manifest.columns else F.lit(None).cast("string")
    own = docs.drop("description") if "description" in docs.columns else docs
    return own.join(about, "path", "left").select("path", F.coalesce("parent_doc_id", text.reader_id(F.col("path"))).alias("parent_doc_id"), F.coalesce(given, F.left("content", F.lit(200))).alias("summary"))
