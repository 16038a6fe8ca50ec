"""Front matter, HTML metadata and HTML conversion.

Front matter counts at the very start of a file only; all its keys are kept. A title
or description that is missing stays null, so that later fallbacks apply.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths

FRONT = r"\A---[ \t]*\r?\n(?s:(.*?)\r?\n)?---[ \t]*(?:\r?\n|\z)"


def without_front_matter(content: Column) -> Column:
    """P1."""
    return F.regexp_replace(content, FRONT, "")


def front_matter(content: Column) -> Column:
    """``word: value`` lines of the front matter as a map; outer quotes go, the last of a key wins."""
    block = F.regexp_extract(content, FRONT, 1)
    line = r"(?m)^(\w+):[ \t]*(\S.*?)[ \t\r]*$"
    keys = F.regexp_extract_all(block, F.lit(line), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(line), F.lit(2)), lambda v: F.regexp_replace(v, r"""\A["']|["']\z""", ""))
    return last_wins(keys, values)


def last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays; of equal keys the last counts, whatever the session's policy."""
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"), i.alias("i")))
    kept = F.filter(pairs, lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.size(keys) + 1), lambda k: k == p["k"]))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))


def html_title(content: Column) -> Column:
    """Null without a title."""
    return F.nullif(F.trim(F.regexp_extract(content, r"(?i)<title\b[^>]*+>([^<]+)</title>", 1)), F.lit(""))


def html_meta(content: Column) -> Column:
    """The ``meta`` elements whose name comes before their content, as a map."""
    value = r"[\x22\x27]([^\x22\x27]+)[\x22\x27]"
    rule = rf"(?i)<meta\s+name={value}\s+content={value}"
    return last_wins(F.regexp_extract_all(content, F.lit(rule), F.lit(1)), F.regexp_extract_all(content, F.lit(rule), F.lit(2)))


class _Markdown(HTMLParser):
    """HTML to Markdown: ATX headings, fenced code, star bullets, links, images, emphasis."""

    DROPPED = {"script", "style", "noscript", "template", "title"}
    BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "figure", "address", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.skip = self.pre = self.quote = 0
        self.links: list[str] = []

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in self.DROPPED:
            self.skip += 1
            return
        if self.skip:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and self.pre:
            language = next((c[9:] for c in a.get("class", "").split() if c.startswith("language-")), "")
            if language and self.out[-1] == "\n\n```\n":
                self.out[-1] = f"\n\n```{language}\n"
        elif tag == "code":
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, int(a["start"]) - 1 if a.get("start", "").isdigit() else 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            mark = "*   " if kind[0] == "ul" else f"{kind[1]}.  "
            self.out.append("\n" + "    " * max(len(self.lists) - 1, 0) + mark)
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a":
            self.links.append(a.get("href", ""))
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt', '')}]({a.get('src', '')})")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("\n")
        elif tag in self.BLOCKS:
            self.block()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag[:1] == "h" and tag[1:].isdigit() or tag == "blockquote" or tag in self.BLOCKS:
            self.block()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
            if not self.out or self.out[-1].endswith(("\n", " ")):
                data = data.lstrip()
        self.out.append(data)


def to_markdown(source: str | None) -> str | None:
    """P5: Markdown of an HTML text; the text itself if it cannot be read."""
    if source is None:
        return None
    try:
        parser = _Markdown()
        parser.feed(source)
        parser.close()
    except (ValueError, AssertionError):
        return html.unescape(source)
    lines = [line.rstrip() if not line.endswith("  ") else line for line in "".join(parser.out).split("\n")]
    out: list[str] = []
    for line in lines:
        if line.strip() or (out and out[-1].strip()):
            out.append(line)
    return "\n".join(out).strip()


def markdown(content: Column) -> Column:
    """P5 as a column: the one step that needs Python, in Arrow batches."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(to_markdown)

    return convert(content)


def is_html(path: Column) -> Column:
    return F.lower(path).endswith(".html")


def documents(files: DataFrame, default_title: str | None = None) -> DataFrame:
    """Files (path, content[, mtime, size]) as documents; an HTML path gains ``.md``.

    ``default_title``: title of documents that name none, null to leave it open.
    """
    return documents_of(files.where(~is_html(F.col("path"))), files.where(is_html(F.col("path"))), default_title)


def documents_of(plain: DataFrame, web: DataFrame, default_title: str | None = None) -> DataFrame:
    """``documents`` of files that are parted already: HTML takes the way through Python, Markdown never does."""
    raw, path = F.col("content"), F.col("path")
    other = [c for c in ("mtime", "size") if c in plain.columns]
    plain = plain.select(
        path, path.alias("original_path"), front_matter(raw).alias("metadata"), without_front_matter(raw).alias("content"), F.lit(False).alias("is_html"), *other
    )
    meta = F.map_concat(
        F.map_filter(html_meta(raw), lambda k, _: k != "title"), F.when(html_title(raw).isNotNull(), F.create_map(F.lit("title"), html_title(raw))).otherwise(F.expr("map()").cast("map<string,string>"))
    )
    web = web.select(F.concat(path, F.lit(".md")).alias("path"), path.alias("original_path"), meta.alias("metadata"), markdown(raw).alias("content"), F.lit(True).alias("is_html"), *other)
    both = plain.unionByName(web)
    name = lambda k: F.nullif(F.col("metadata")[k], F.lit(""))
    title = F.coalesce(name("title"), F.lit(default_title)) if default_title else name("title")
    return both.select(
        "path", "original_path", paths.section(F.col("path")).alias("section"), title.alias("title"), name("description").alias("description"), "content", "metadata", "is_html",
        *(["mtime"] if "mtime" in other else []), *([F.col("size").alias("raw_size")] if "size" in other else []),
    )


#: The root index as Markdown, MDX, HTML.
ROOT_INDEX = ("index.md", "index.mdx", "index.html")


def root_order() -> Column:
    """1, 2, 3 for the root index as Markdown, MDX, HTML; 0 for other files."""
    return F.array_position(F.array(*map(F.lit, ROOT_INDEX)), F.col("path"))


def site_metadata(files: DataFrame, name: str) -> DataFrame:
    """One row (title, description, instructions) from the root index, or from the directory's name."""
    order = root_order()
    top = files.where(order > 0).agg(F.min_by(F.struct("path", "content"), order).alias("x"))
    is_html = F.col("x.path").endswith(".html")
    meta = F.when(is_html, html_meta(F.col("x.content"))).otherwise(front_matter(F.col("x.content")))
    got = lambda k: F.nullif(meta[k], F.lit(""))
    title = F.coalesce(F.when(is_html, html_title(F.col("x.content"))), got("title"), F.lit(name))
    return top.select(title.alias("title"), F.coalesce(got("description"), F.lit(f"Documentation and resources for {name}.")).alias("description"), got("instructions").alias("instructions"))
