"""Links (T1, T2, J1, J2, J20, F7, F8, U1).

Links stay rows with their position. Resolution is one equi-join of candidate targets
with the set of paths; which side is broadcast is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths

#: Brackets are written as code points.
LABEL, URL = r"\x5B([^\x5D]*)\x5D", r"\x28([^\s\x29]+)(?:\s+\x22[^\x22]*\x22)?\x29"
INLINE = LABEL + URL
USE = LABEL.replace("*", "+") + LABEL
DEFINITION = "(?m)^" + LABEL.replace("*", "+") + r":\s*(\S+)"


def external(url: Column) -> Column:
    """F7."""
    return url.rlike(r"\A(?:https?://|mailto:|//)")


def absolute(url: Column) -> Column:
    """F8: the URL has a scheme."""
    return url.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:\S")


LINK = "array<struct<style:string,pos:int,text:string,url:string>>"


def inline_array(content: Column) -> Column:
    """Structs (style, pos, text, url) of ``[text](url "title")``."""
    texts, urls = (F.regexp_extract_all(content, F.lit(INLINE), F.lit(i)) for i in (1, 2))
    return F.zip_with(F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), urls, lambda x, u: F.struct(F.lit("inline").alias("style"), x["i"].alias("pos"), x["t"].alias("text"), u.alias("url"))).cast(LINK)


def reference_array(content: Column) -> Column:
    """The same of ``[text][ref]`` and ``[text][]``; the last definition of a name wins, uses without one drop out."""
    names = F.transform(F.regexp_extract_all(content, F.lit(DEFINITION), F.lit(1)), F.lower)
    urls = F.regexp_extract_all(content, F.lit(DEFINITION), F.lit(2))
    texts, refs = (F.regexp_extract_all(content, F.lit(USE), F.lit(i)) for i in (1, 2))
    key = lambda t, r: F.lower(F.coalesce(F.nullif(r, F.lit("")), t))
    place = lambda k: F.size(names) - F.array_position(F.reverse(names), k)  # noqa: E731 - 0-based, of the last definition
    uses = F.zip_with(F.transform(texts, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), refs, lambda x, r: F.struct(x["i"].alias("pos"), x["t"].alias("text"), key(x["t"], r).alias("key")))
    known = F.filter(uses, lambda u: F.array_contains(names, u["key"]))
    return F.transform(known, lambda u: F.struct(F.lit("reference").alias("style"), u["pos"].alias("pos"), u["text"].alias("text"), F.get(urls, place(u["key"])).alias("url"))).cast(LINK)


def inline(docs: DataFrame) -> DataFrame:
    """(source, style, pos, text, url)."""
    return docs.select(F.col("path").alias("source"), F.explode(inline_array(F.col("content"))).alias("x")).select("source", "x.*")


def reference(docs: DataFrame) -> DataFrame:
    """(source, style, pos, text, url)."""
    return docs.select(F.col("path").alias("source"), F.explode(reference_array(F.col("content"))).alias("x")).select("source", "x.*")


def candidates(url: Column, source: Column) -> Column:
    """Where a link may lead, in order: the path itself, with ``.md``, its index, without ``./``."""
    clean = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    folder = paths.directory(source)
    joined = paths.normalized(F.when(folder != "", F.concat(folder, F.lit("/"), clean)).otherwise(clean), keep_above=True)
    return F.when(clean != "", F.array(joined, F.concat(joined, F.lit(".md")), F.concat(joined, F.lit("/index.md")), F.regexp_replace(joined, r"\A\./", "")))


def edges(docs: DataFrame) -> DataFrame:
    """(source, target, anchor, text, type, pos) of all links; internal ones that lead nowhere drop out.

    Links of the text come first (``pos`` from 0), then those by reference, as two
    kinds of ``style``.
    """
    all_ = F.concat(inline_array(F.col("content")), reference_array(F.col("content")))
    found = docs.where("content is not null").select(F.col("path").alias("source"), F.explode(all_).alias("x")).select("source", "x.*")
    url = F.col("url")
    own = (F.col("style") == "inline") & url.startswith("#")
    # links that need no resolution, in one pass; the others in a second
    self_ = found.where(own | external(url)).select(
        "source", F.when(own, F.col("source")).otherwise(url).alias("target"), F.when(own, F.substring(url, 2, 1 << 30)).alias("anchor"), "text",
        F.when(own, "internal-anchor").otherwise("external").alias("type"), "style", "pos",
    )
    inside = found.where(~external(url) & ~own).select("source", "text", "style", "pos", "url", F.posexplode(candidates(url, F.col("source"))).alias("nth", "candidate"))
    known = docs.select(F.col("path").alias("candidate")).distinct()
    hit = inside.join(known, "candidate").groupBy("source", "style", "pos", "text", "url").agg(F.min_by("candidate", "nth").alias("target"))
    anchor = F.nullif(F.split_part("url", F.lit("#"), F.lit(2)), F.lit(""))
    kind = F.when((F.col("style") == "inline") & anchor.isNotNull(), "internal-anchor").otherwise("internal")
    inside = hit.select("source", "target", anchor.alias("anchor"), "text", kind.alias("type"), "style", "pos")
    return self_.unionByName(inside)


def broken(docs: DataFrame) -> DataFrame:
    """(document, pos, target, resolved) of internal links that lead to no document."""
    url = F.col("url")
    tested = inline(docs).where(~url.rlike(r"\A(?:https?://|mailto:|#)"))
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    folder = paths.directory(F.col("source"))
    joined = F.when(folder != "", F.concat(folder, F.lit("/"), bare)).otherwise(bare)
    resolved = F.when(bare == "", F.col("source")).otherwise(paths.normalized(F.regexp_replace(joined, r"\A\./", ""), keep_above=False))
    tested = tested.select(F.col("source").alias("document"), "pos", url.alias("target"), resolved.alias("resolved"))
    options = F.explode(F.array("resolved", F.concat("resolved", F.lit(".md")), F.concat("resolved", F.lit("/index.md"))))
    reached = tested.select("document", "pos", options.alias("path")).join(docs.select("path").distinct(), "path", "left_semi").select("document", "pos").distinct()
    return tested.join(reached, ["document", "pos"], "left_anti")
