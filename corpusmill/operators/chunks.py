"""Chunks with citations.

Packing paragraphs is a fold that resets: whether a chunk ends depends on where the
one before ended, which no window frame says. Each document is folded on its own in
an Arrow map, so a corpus of any size is chunked without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """V3: sizes in tokens; code blocks count ``code_weight`` times."""

    target: int = 1000
    most: int = 1500
    code_weight: float | None = None


PROFILES = {
    "default": Profile(),
    "code-heavy": Profile(1200, 2000, 0.5),
    "faq": Profile(500, 800),
    "granular": Profile(400, 600),
    "large-context": Profile(3000, 5000),
}
SCHEMA = (
    "chunk_id string, doc_id string, content string, token_count int, source_path string, heading_path string, section_title string, section_level int, "
    "line_range struct<start:int,end:int>, byte_range struct<start:int,end:int>, chunk_index int, has_code boolean, has_list boolean, language_hints array<string>"
)
HEADING = re.compile(r"\A(#{1,6})\s+(.+)\Z")
LANGUAGE = re.compile(r"```([A-Za-z0-9_]+)")


def anchor(title: str) -> str:
    kept = re.sub(r"[^A-Za-z0-9_\s-]", "", title.lower())
    return re.sub("-+", "-", re.sub(r"\s+", "-", kept)).strip()


def is_code_block(text: str) -> bool:
    return text.startswith("```") and "\n```" in text


def tokens(text: str, profile: Profile) -> int:
    weight = profile.code_weight if profile.code_weight and is_code_block(text) else 1
    return -int(-len(text) * weight // 4)


def sections(content: str) -> Iterator[tuple[int, int, str | None, list[str]]]:
    """(line of the heading, level, title, lines); the part before any heading comes first, with level 0."""
    start, level, title, own = 0, 0, None, []
    for i, line in enumerate(content.split("\n"), 1):
        if m := HEADING.match(line):
            yield start, level, title, own
            start, level, title, own = i, len(m[1]), m[2].strip(), []
        else:
            own.append(line)
    yield start, level, title, own


def paragraphs(lines: list[str]) -> Iterator[str]:
    """Parts between blank lines; a fenced block is a part of its own."""
    own: list[str] = []
    fenced = False
    for line in lines:
        if line.startswith("```"):
            if fenced:
                own.append(line)
                yield "\n".join(own)
                own = []
            else:
                if own:
                    yield "\n".join(own)
                own = [line]
            fenced = not fenced
        elif fenced or line.strip():
            own.append(line)
        elif own:
            yield "\n".join(own)
            own = []
    if own:
        yield "\n".join(own)


def packed(lines: list[str], offset: int, profile: Profile) -> Iterator[tuple[str, int, int]]:
    """(text, first line, last line). A part that would exceed the maximum starts a
    chunk; a chunk ends at its target, unless its last part is code. No part is ever cut."""
    if not any(line.strip() for line in lines):
        return
    own: list[str] = []
    size, begin, at = 0, offset, offset
    for part in paragraphs(lines):
        n = tokens(part, profile)
        if own and size + n > profile.most:
            yield "\n\n".join(own).strip(), begin, at
            own, size, begin = [], 0, at
        own.append(part)
        size += n
        at += part.count("\n") + 1
        if size >= profile.target and not is_code_block(part):
            yield "\n\n".join(own).strip(), begin, at
            own, size, begin = [], 0, at
    if own:
        yield "\n\n".join(own).strip(), begin, at


def chunk_document(path: str, content: str, profile: Profile) -> Iterator[dict]:
    """A document's chunks; the part before any heading is numbered last but comes first."""
    doc = hashlib.sha256((path + content).encode()).hexdigest()[:8]
    starts = [0]
    for line in content.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    place = lambda line: starts[min(max(line - 1, 0), len(starts) - 1)] if content else 0
    first, *rest = sections(content)
    found = [(s, *c) for s in rest for c in packed(s[3], s[0], profile)] + [(first, *c) for c in packed(first[3], 0, profile)]
    numbered = list(enumerate(found))
    split = sum(s[1] > 0 for s, *_ in found)
    for index, ((_, level, title, _), text, start, end) in numbered[split:] + numbered[:split]:
        heading = anchor(title) if title is not None else ""
        yield {
            "chunk_id": hashlib.sha256(f"{doc}:{heading}:{index}".encode()).hexdigest()[:16], "doc_id": doc, "content": text, "token_count": tokens(text, profile),
            "source_path": path, "heading_path": heading, "section_title": title or None, "section_level": level or None,
            "line_range": {"start": start, "end": end}, "byte_range": {"start": place(start), "end": place(end)}, "chunk_index": index,
            "has_code": bool(re.search(r"```[\s\S]*?```|`[^`]+`", text)), "has_list": bool(re.search(r"^[-*+]\s|^[0-9]+\.\s", text, re.M)),
            "language_hints": list(dict.fromkeys(LANGUAGE.findall(text))),
        }


def chunks(docs: DataFrame, profile: Profile | str = "default") -> DataFrame:
    """One row per chunk (schema SCHEMA) of documents (path, content); null content has none."""
    chosen = PROFILES[profile] if isinstance(profile, str) else profile
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = pa.schema(
        [("chunk_id", pa.string()), ("doc_id", pa.string()), ("content", pa.string()), ("token_count", pa.int32()), ("source_path", pa.string()), ("heading_path", pa.string()), ("section_title", pa.string()), ("section_level", pa.int32())]
        + [("line_range", span), ("byte_range", span), ("chunk_index", pa.int32()), ("has_code", pa.bool_()), ("has_list", pa.bool_()), ("language_hints", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += chunk_document(path, content or "", chosen)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return docs.select("path", "content").where("path is not null").mapInArrow(run, SCHEMA)


def statistics(found: DataFrame) -> DataFrame:
    """A5: one row; averages and bounds are null without chunks."""
    return found.agg(
        F.count("*").alias("total_chunks"), F.countDistinct("source_path").alias("documents"), F.sum(F.col("token_count").cast("bigint")).alias("total_tokens"),
        F.round(F.avg("token_count"), 4).alias("average_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.count_if("has_code").alias("with_code"),
    )
