"""Functions of relative paths."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def section(path: Column, root: str = "Root") -> Column:
    """The first path segment; ``root`` for files at the top."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(root))


def title(path: Column) -> Column:
    """The file name without its last extension, dashes and underscores as blanks."""
    return F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]+\z", ""), "[-_]", " ")


def title_case(text: Column) -> Column:
    """First letter of each blank-separated word raised, the rest left as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def document_title(metadata: Column, path: Column) -> Column:
    """The metadata's title, or one made of the path."""
    return F.coalesce(F.nullif(metadata["title"], F.lit("")), title(path))


def document_notes(metadata: Column) -> Column:
    """The metadata's notes, or its description; empty if neither."""
    return F.coalesce(F.nullif(metadata["notes"], F.lit("")), F.nullif(metadata["description"], F.lit("")), F.lit(""))


def absolute_url(path: Column, base: str | None) -> Column:
    """The path resolved against ``base``; plain concatenation where the path is safe ASCII."""
    if not base:
        return path

    @F.pandas_udf("string")
    def join(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else urljoin(base, p))

    folder = base if base.endswith("/") else base[: base.rfind("/") + 1]
    safe = path.rlike(r"\A[A-Za-z0-9_\-][A-Za-z0-9_\-./]*\z") & ~path.contains("//") & ~path.rlike(r"(\A|/)\.\.?(/|\z)")
    return F.when(safe, F.concat(F.lit(folder), path)).otherwise(join(path))


def sitemap_url(path: Column, base: str, strip: bool = True) -> Column:
    """Base and path; extensions dropped on demand, a closing ``/index`` becomes ``/``."""
    if strip:
        path = F.regexp_replace(path, r"\.(md|mdx|html)\z", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    # of several ``/index`` the first one gives way
    path = F.when(path.endswith("/index"), F.overlay(path, F.lit("/"), F.instr(path, "/index"), F.lit(6))).otherwise(path)
    return F.concat(F.lit(re.sub(r"/\Z", "", base)), path)


def anchor(heading: Column) -> Column:
    """Lower case, word characters and dashes only, blanks to dashes, runs of dashes once."""
    kept = F.regexp_replace(F.lower(heading), r"[^A-Za-z0-9_\s-]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"))


def directory(path: Column) -> Column:
    """The path up to its last slash, empty at the top."""
    return F.regexp_replace(path, r"(\A|/)[^/]*\z", "")


def normalized(path: Column, keep_above: bool) -> Column:
    """``.`` and ``..`` worked out.

    ``keep_above``: a ``..`` that leaves the root stays (graph flavour, which also drops
    empty segments); else it goes (validator flavour).
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    if keep_above:
        # a trailing slash survives, as in POSIX normalisation
        parts = F.filter(parts, lambda x: (x != "") & (x != "."))
    else:
        parts = F.filter(parts, lambda x: x != ".")

    def step(stack: Column, part: Column) -> Column:
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        if keep_above:
            up = F.when((F.size(stack) == 0) | (F.element_at(stack, -1) == ".."), F.concat(stack, F.array(part))).otherwise(popped)
        else:
            up = popped
        return F.when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: step(s, x)), "/")
    if keep_above:
        out = F.when(path.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """X11: the last dot and what follows, or nothing."""
    return F.regexp_extract(name, r"(\.[^.]*)\z", 1)


def display_name(name: Column) -> Column:
    """A file name without a document extension."""
    return F.regexp_replace(name, r"\.(md|mdx|html)\z", "")


def normalized_tag(tag: Column) -> Column:
    """X13."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(tag)), r"[\s_]+", "-"), "[^a-z0-9:-]", "")


def sanitized_for_log(text: Column, most: int = 1000) -> Column:
    """Control characters as blanks, at most ``most`` characters."""
    return F.left(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), F.lit(most))


def sanitized_filename(name: Column) -> Column:
    """No separators, control or shell characters, no leading dots, 255 characters at most."""
    kept = F.regexp_replace(name, r"""[\x00-\x1F<>:"/\\|?*]""", "_")
    kept = F.regexp_replace(F.regexp_replace(kept, r"\A\.+", ""), r"\.+\z", "")
    return F.coalesce(F.nullif(F.left(kept, F.lit(255)), F.lit("")), F.lit("unnamed"))


def sanitized_url(url: Column) -> Column:
    """Http and https only, without credentials; null for anything else."""
    plain = F.regexp_replace(F.trim(url), r"(?i)\A(https?://)[^/@\s]*@", "$1")
    return F.when(plain.rlike(r"(?i)\Ahttps?://[^\s]+\z"), plain)


def sanitized_glob(pattern: str) -> str:
    """A glob without parent steps, control characters or runs of over two stars."""
    pattern = re.sub(r"[\x00-\x1f]", "", pattern)
    return re.sub(r"\*{3,}", "**", re.sub(r"(^|/)\.\.(?=/|$)", r"\1", pattern))


def secure_relative(path: str, root: str) -> str:
    """``path`` relative to ``root``; an error if it leaves it."""
    out = posixpath.relpath(posixpath.normpath(posixpath.join(root, path)), root)
    if out == ".." or out.startswith("../"):
        raise ValueError(f"{path} lies outside {root}")
    return out


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regex: ``*`` within a segment, ``**`` across, ``?``, ``[]``, ``{}``."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.sub(r"([\\.^$+(){}|\[\]])", r"\\\1", c))
        i += 1
    return "\\A" + "".join(out) + "\\z"
