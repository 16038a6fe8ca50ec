"""Tags by rules.

All rules fold into one projection, so that every document is read once; a rule set
is a parameter and grows the expression, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import rules


def characteristics(content: Column) -> list[Column]:
    """Tags that the text itself shows."""
    found = lambda tag, test: F.when(test, F.lit(tag))
    n = text.words_split(content)
    return [
        found("has-code", text.has_fence(content)),
        found("has-tables", content.rlike(r"\|.*\|.*\|") & content.rlike(r"\|[-:]+\|")),
        found("has-images", content.rlike(r"!\[.*?\]\(.*?\)")),
        found("has-links", content.rlike(r"\[.*?\]\(.*?\)")),
        found("code-heavy", text.code_share(content) > 0.5),
        found("qa-format", content.rlike(r"(?im)^#+\s*(?:FAQ|Question:|Q:)|\*{2}Q:\*{2}|<strong>Q:</strong>")),
        found("step-by-step", F.regexp_count(content, F.lit(r"(?m)^[0-9]+\.\s+")) >= 3),
        F.when(n < 200, "length:short").when(n > 2000, "length:long").otherwise("length:medium"),
    ]


def from_metadata(metadata: Column) -> Column:
    """Tags, categories, type, audience, and difficulty or level."""
    listed = lambda key: F.transform(F.filter(F.transform(F.split(F.coalesce(metadata[key], F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""), paths.normalized_tag)
    named = lambda value, prefix="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), paths.normalized_tag(value)))
    level = F.coalesce(F.nullif(metadata["difficulty"], F.lit("")), metadata["level"])
    single = F.array_compact(F.array(named(metadata["type"]), named(metadata["audience"], "audience:"), named(level, "level:")))
    return F.concat(listed("tags"), listed("categories"), single)


def tags(
    docs: DataFrame, path_rules: Mapping[str, str] = rules.PATHS, file_rules: Mapping[str, str] = rules.FILES, keyword_rules: Mapping[str, Sequence[str]] = rules.KEYWORDS,
    content_keywords: bool = True,
) -> DataFrame:
    """(path, tags): sorted, each once. ``docs``: path, content[, metadata]."""
    content = F.coalesce(F.col("content"), F.lit(""))
    path = F.lower("path")
    has_meta = "metadata" in docs.columns
    meta = lambda key: F.coalesce(F.col("metadata")[key], F.lit("")) if has_meta else F.lit("")
    notes = F.coalesce(F.nullif(meta("description"), F.lit("")), meta("notes"))
    searched = F.lower(F.concat_ws(" ", meta("title"), notes, content if content_keywords else F.lit("")))

    def by_keyword(text_: Column) -> Column:
        def any_of(words: Sequence[str]) -> Column:
            out = text_.contains(words[0].lower())
            for w in words[1:]:
                out = out | text_.contains(w.lower())
            return out

        tests = [F.when(any_of(words), F.lit(tag)) for tag, words in keyword_rules.items() if words]
        return F.array_compact(F.array(F.lit(None).cast("string"), *tests))

    found = [F.when(path.rlike(rule), F.lit(tag)) for rule, tag in path_rules.items()]
    found += [F.when(paths.basename(path).rlike(rule), F.lit(tag)) for rule, tag in file_rules.items()]
    # as the variable of a function the lowered text is made once, not once for every keyword
    keywords = F.element_at(F.transform(F.array(searched), by_keyword), 1)
    found += characteristics(content)
    languages = F.transform(text.code_languages(content, lower=True), lambda x: F.concat(F.lit("lang:"), x))
    languages = F.when(text.has_fence(content), languages).otherwise(F.array().cast("array<string>"))
    parts = [F.array_compact(F.array(*found)), keywords, languages] + ([from_metadata(F.col("metadata"))] if has_meta else [])
    return docs.select("path", F.array_sort(F.array_distinct(F.concat(*parts))).alias("tags"))


def long_form(tagged: DataFrame) -> DataFrame:
    """(path, tag).

    Every document has a tag of its length. An inner explode would add a filter on the
    array's size, and with it all rules a second time.
    """
    return tagged.select("path", F.explode_outer("tags").alias("tag"))


def inverted(tagged: DataFrame) -> DataFrame:
    """(tag, paths), paths sorted."""
    return long_form(tagged).groupBy("tag").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def counts(tagged: DataFrame) -> DataFrame:
    """A6."""
    return long_form(tagged).groupBy("tag").agg(F.count("*").alias("documents"))
