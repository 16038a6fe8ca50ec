"""Sitemap, directory index and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text


def _meta(docs: DataFrame, key: str) -> Column:
    return F.nullif(F.col("metadata")[key], F.lit("")) if "metadata" in docs.columns else F.lit(None).cast("string")


def sitemap(docs: DataFrame, base: str, strip: bool = True) -> DataFrame:
    """P10: (url, changefreq, priority[, lastmod]) of documents (path[, original_path, metadata, mtime])."""
    low = F.lower("path")
    shown = F.coalesce("original_path", "path") if "original_path" in docs.columns else F.col("path")
    has = lambda *parts: low.rlike("|".join(parts))
    rate = F.when(has("index", "home"), "weekly").when(has("doc", "tutorial", "api", "reference"), "monthly").otherwise("yearly")
    given = lambda key: F.when(_meta(docs, key).try_cast("double").between(0, 1), _meta(docs, key).try_cast("double"))
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.0\z", "")
    usual = F.when(has("index", "home"), "1.0").when(has("doc", "tutorial", "getting-started"), "0.8").when(has("api", "reference"), "0.7").otherwise("0.5")
    out = docs.select(
        paths.sitemap_url(shown, base, strip).alias("url"), F.coalesce(_meta(docs, "changefreq"), _meta(docs, "sitemap-changefreq"), rate).alias("changefreq"),
        F.coalesce(plain(given("priority")), plain(given("sitemap-priority")), usual).alias("priority"), *(["mtime"] if "mtime" in docs.columns else []),
    )
    if "mtime" in docs.columns:
        out = out.withColumn("lastmod", F.date_format(F.to_utc_timestamp("mtime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).drop("mtime")
    return out


def sitemap_lines(entries: DataFrame) -> DataFrame:
    """(text) lines of the entries' XML, ordered by address."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), text.xml_escaped(value), F.lit(f"</{name}>"))
    fields = [tag("loc", F.col("url"))] + ([tag("lastmod", F.col("lastmod"))] if "lastmod" in entries.columns else []) + [tag("changefreq", F.col("changefreq")), tag("priority", F.col("priority"))]
    rows = entries.select(F.lit(1).alias("at"), "url", F.concat(F.lit("  <url>"), *fields, F.lit("</url>")).alias("text"))
    schema = "http://" + "www.sitemaps.org/schemas/sitemap/0.9"
    edges = [(-1, "", '<?xml version="1.0" encoding="utf-8"?>'), (0, "", f'<urlset xmlns="{schema}">'), (2, "", "</urlset>")]
    edges = entries.sparkSession.createDataFrame(edges, "at int, url string, text string")
    return rows.unionByName(edges).orderBy("at", "url", "text").select("text")


def sitemap_xml(entries: DataFrame) -> DataFrame:
    """The entries as one XML text, for a site of one row's size; ``sitemap_lines`` is for any."""
    rows = sitemap_lines(entries).select(F.struct(F.monotonically_increasing_id().alias("i"), "text").alias("x"))
    return rows.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n"), F.lit("\n")).alias("xml"))


def directories(files: DataFrame) -> DataFrame:
    """(path, parent, depth) of every directory above a file; the root is the empty path, without a parent."""
    parts = F.split(paths.directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = files.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("path")).distinct()
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return found.select("path", F.when(F.col("path") != "", paths.directory(F.col("path"))).alias("parent"), depth.alias("depth"))


def entries(files: DataFrame) -> DataFrame:
    """(parent, name, path, size, type, extension, is_markdown) of files (path, size)."""
    name, p = paths.basename(F.col("path")), F.col("path")
    return files.select(
        paths.directory(p).alias("parent"), name.alias("name"), "path", "size", F.lit("file").alias("type"), paths.extension(name).alias("extension"),
        F.lower(name).rlike(r"\.(md|mdx|html)\z").alias("is_markdown"),
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """Per directory the files, markdown files and bytes in it (not below it), and its subdirectories."""
    all_ = directories(files)
    own = entries(files).groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("files"), F.count_if("is_markdown").alias("markdown_files"), F.sum(F.col("size").cast("bigint")).alias("bytes"))
    subs = all_.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("subdirectories"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return all_.join(own, "path", "left").join(subs, "path", "left").select("path", "depth", zero("files"), zero("subdirectories"), zero("markdown_files"), zero("bytes"))


def master_totals(rollup: DataFrame) -> DataFrame:
    """One row over all directories."""
    return rollup.agg(F.count("*").alias("directories"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "subdirectories", "markdown_files", "bytes")))


def toc(docs: DataFrame) -> DataFrame:
    """(parent, path, depth, line) of a contents list: indent by depth, name, link and line count.

    Order by (depth, parent, path) for a list per directory, by path for the whole.
    """
    p = F.col("path")
    depth = F.size(F.split(p, "/")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- ["), paths.display_name(paths.basename(p)), F.lit("]("), p, F.lit(") ("), text.lines("content").cast("string"), F.lit(" lines)"))
    return docs.select(paths.directory(p).alias("parent"), "path", depth.alias("depth"), line.alias("line"))


def toc_files(docs: DataFrame) -> DataFrame:
    """(directory, text) with a heading, a link to the parent directory, and the lines of its documents."""
    rows = toc(docs).groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", F.ltrim("line").alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    name = F.when(F.col("parent") == "", "Contents").otherwise(F.col("parent"))
    up = F.when(F.col("parent") == "", "").otherwise(F.lit("[..](../toc.md)\n\n"))
    return rows.select(F.col("parent").alias("directory"), F.concat(F.lit("# "), name, F.lit("\n\n"), up, "body", F.lit("\n")).alias("text"))


def toc_lines(docs: DataFrame) -> DataFrame:
    """The lines of ``toc_files`` as rows (file, part, at, key, text) of ``sinks.write_listed``."""
    items = toc(docs).select(_file("toc.md"), F.lit(0).alias("part"), F.lit(1).alias("at"), F.col("path").alias("key"), F.ltrim("line").alias("text"))
    up = F.when(F.col("parent") == "", F.lit("# Contents\n")).otherwise(F.concat(F.lit("# "), "parent", F.lit("\n\n[..](../toc.md)\n")))
    heads = docs.select(paths.directory(F.col("path")).alias("parent")).distinct()
    return items.unionByName(heads.select(_file("toc.md"), F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit("").alias("key"), up.alias("text")))


def index_lines(own: DataFrame) -> DataFrame:
    """``entries`` as rows (file, part, at, key, text) of ``sinks.write_listed``: an object for each directory, a line for each of its files."""
    shown = ["name", *(c for c in own.columns if c != "name")]
    items = own.select(_file("index.json"), F.lit(0).alias("part"), F.lit(1).alias("at"), F.col("name").alias("key"), F.to_json(F.struct(*shown)).alias("text"))
    of = own.select("parent").distinct()
    edge = lambda at, line: of.select(_file("index.json"), F.lit(0).alias("part"), F.lit(at).alias("at"), F.lit("").alias("key"), line.alias("text"))
    name = F.to_json(F.struct(F.col("parent").alias("path")))
    return items.unionByName(edge(0, F.concat(F.regexp_replace(name, r"\}\z", ""), F.lit(', "files": [')))).unionByName(edge(2, F.lit("]}")))


def _file(name: str) -> Column:
    return F.when(F.col("parent") == "", F.lit(name)).otherwise(F.concat("parent", F.lit("/" + name))).alias("file")
