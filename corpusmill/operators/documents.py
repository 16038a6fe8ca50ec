"""Sections and document order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text

#: Substrings that make a path important when documents are ordered.
IMPORTANT = ("doc", "get-started", "getting-started", "intro", "quick-start", "quickstart", "start", "tutorial")
#: The same when bundles are filled.
IMPORTANT_IN_BUNDLES = ("api", "doc", "getting-started", "guide", "intro", "overview", "quick-start", "quickstart", "reference", "tutorial", "usage")


def contains_any(path: Column, parts: Iterable[str]) -> Column:
    return F.lower(path).rlike("|".join(parts))


def is_index(path: Column) -> Column:
    """index, readme and home files."""
    return F.lower(path).rlike(r"(?:\A|/)(?:index|readme|home)\.(?:md|mdx|html)\z|/(?:index|readme|home)\.")


def is_important(path: Column) -> Column:
    """F5."""
    return contains_any(path, IMPORTANT)


def priority(path: Column) -> Column:
    """O2: 1 index, 2 readme, 3 home, 4 other index-like files, 100 important, 200 the rest."""
    name = F.lower(paths.basename(path))
    kind = F.when(name.rlike(r"\Aindex\."), 1).when(name.rlike(r"\Areadme\."), 2).when(name.rlike(r"\Ahome\."), 3).otherwise(4)
    return F.when(is_index(path), kind).when(is_important(path), 100).otherwise(200)


def optional(path: Column, globs: Iterable[str]) -> Column:
    """F3."""
    globs = list(globs)
    return path.rlike("|".join(paths.glob_to_regex(g) for g in globs)) if globs else F.lit(False)


def ordered(docs: DataFrame, optional_globs: Iterable[str] = ()) -> DataFrame:
    """``docs`` with section, priority, is_optional and sort keys; see ``order_keys``.

    HTML documents are judged by their original path.
    """
    judged = F.coalesce(F.col("original_path"), F.col("path")) if "original_path" in docs.columns else F.col("path")
    section = paths.section(F.col("path"))
    return docs.withColumns({"section": section, "priority": priority(judged), "is_optional": optional(F.col("path"), optional_globs)})


def order_keys() -> list[Column]:
    """Regular documents before optional ones; the root section first, others by name; then priority and path."""
    by_section = [F.when(F.col("is_optional"), F.lit(None)).otherwise(x) for x in (F.col("section") != "Root", F.col("section"))]
    return [F.col("is_optional"), *by_section, F.col("priority"), F.col("path")]


def legacy_ordered(docs: DataFrame) -> DataFrame:
    """O3: (path, class, class_rank): index files by kind, then important and other ones by locale order."""
    kind = F.when(is_index(F.col("path")), 0).when(is_important(F.col("path")), 1).otherwise(2)
    rank = F.when(kind == 0, priority(F.col("path"))).otherwise(0)
    return docs.select("path", kind.alias("class"), rank.alias("class_rank")).orderBy("class", "class_rank", F.collate("path", "UNICODE"))


def section_rollup(docs: DataFrame) -> DataFrame:
    """Per section the number of documents, words and bytes."""
    return docs.groupBy(paths.section(F.col("path")).alias("section")).agg(
        F.count("*").alias("documents"), F.sum(text.words("content").cast("bigint")).alias("words"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes")
    )


def statistics(docs: DataFrame) -> DataFrame:
    """X21-X26 per document."""
    c = F.col("content")
    return docs.select(
        "path", text.document_id(F.col("path"), c).alias("id"), F.octet_length(c).alias("size"), text.words(c).alias("word_count"), text.lines(c).alias("line_count"),
        text.tokens(c).alias("token_estimate"), text.has_code(c).alias("has_code"), text.has_list(c).alias("has_list"),
    )
