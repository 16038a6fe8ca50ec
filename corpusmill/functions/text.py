"""Text measures, detectors, identifiers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?s)```.*?```"
BOILERPLATE = (
    "all rights reserved", "as mentioned", "as shown above", "back to top", "click here", "copyright",
    "for more information", "please refer to", "read more", "see also", "table of contents",
)
EXAMPLE = (
    r"\AAKIAX{16}\z|(?i)\Axxx+\z|\Aexample|\Ayour[_-]?|\Atest[_-]?|\Asample|\Aplaceholder|\Adummy|example\.com|localhost"
    r"|\A\*+\z|\A\.\.\.\z|127\.0\.0\.1|0\.0\.0\.0"
)


def length16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def tokens(text: Column, weight: float | None = None) -> Column:
    """A quarter of the length, rounded up; code blocks count ``weight`` times that."""
    plain = F.ceil(F.length(text) / 4)
    if weight is None:
        return plain.cast("int")
    return F.when(is_code_block(text), F.ceil(F.length(text) / 4 * weight)).otherwise(plain).cast("int")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def words_split(text: Column) -> Column:
    """Pieces of a split at white space; an edge of white space adds an empty piece."""
    return F.size(F.split(text, r"\s+", -1))


def lines(text: Column) -> Column:
    """X23."""
    return F.size(F.split(text, "\n", -1))


def has_fence(text: Column) -> Column:
    return text.rlike(FENCED)


def has_code(text: Column) -> Column:
    """A fenced block or inline code."""
    return text.rlike(FENCED) | text.rlike("`[^`]+`")


def is_code_block(text: Column) -> Column:
    """X25."""
    return text.startswith("```") & text.contains("\n```")


def has_list(text: Column) -> Column:
    """X26."""
    return text.rlike(r"(?dm)^[-*+]\s|^\d+\.\s")


def code_languages(text: Column, lower: bool = False) -> Column:
    """Languages of fences, in order, once each."""
    found = F.regexp_extract_all(text, F.lit(r"```(\w+)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def code_share(text: Column) -> Column:
    """The share of the text's length that is in fenced blocks; 0 for an empty text."""
    inside = F.aggregate(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(text) > 0, inside / F.length(text)).otherwise(F.lit(0.0))


def boilerplate_ratio(text: Column) -> Column:
    """Words of stock phrases per word."""
    low = F.lower(text)
    hits = [(F.size(F.split(low, phrase, -1)) - 1) * len(phrase.split(" ")) for phrase in BOILERPLATE]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / words_split(text)


def has_explanation(text: Column) -> Column:
    """ten words or more outside of fenced blocks."""
    return words(F.regexp_replace(text, FENCED, "")) >= 10


def in_code_block(text: Column, position: Column) -> Column:
    """an odd number of fence marks stands before the 0-based position."""
    return F.regexp_count(F.substring(text, F.lit(1), position), F.lit("```")) % 2 == 1


def likely_example(text: Column) -> Column:
    """F9."""
    return text.rlike(EXAMPLE)


def masked(secret: Column) -> Column:
    """Stars; of over eight characters the first and last four stay."""
    n = F.length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(secret, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(secret, F.lit(4))))


def document_id(path: Column, content: Column, digits: int = 12) -> Column:
    """Leading hex digits of the SHA-256 of path and content."""
    return F.substring(F.sha2(F.concat(path, F.coalesce(content, F.lit(""))), 256), 1, digits)


def chunk_id(doc_hash: Column, heading_path: Column, index: Column) -> Column:
    """X32."""
    return F.substring(F.sha2(F.concat_ws(":", doc_hash, heading_path, index.cast("string")), 256), 1, 16)


def reader_id(path: Column) -> Column:
    """X33."""
    return F.substring(F.sha2(path, 256), 1, 12)


def rolling_hash(text: Column) -> Column:
    """The 32-bit hash h * 31 + c over UTF-16 units, signed, in base 36."""
    units = F.encode(text, "UTF-16BE")
    code = lambda i: F.conv(F.hex(F.substring(units, i * 2 - 1, F.lit(2))), 16, 10).cast("bigint")
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), (F.length(units) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: (a * 31 + code(i)) % (1 << 32))
    digits = F.lower(F.conv(F.when(h >= 1 << 31, (1 << 32) - h).otherwise(h).cast("string"), 10, 36))
    return F.when(h >= 1 << 31, F.concat(F.lit("-"), digits)).otherwise(digits)


def citation(path: Column, headings: Column, start: Column, end: Column) -> Column:
    """Path, headings if any, and the line range."""
    where = F.when(F.length(headings) > 0, F.concat(F.lit("§ "), headings))
    return F.concat_ws(" ", path, where, F.concat(F.lit("L"), start.cast("string"), F.lit("-"), end.cast("string")))


def size_label(n: int) -> str:
    """2000 -> 2k."""
    return f"{n // 1000}k" if n >= 1000 else str(n)


def bytes_label(n: Column) -> Column:
    """Bytes with a binary unit and two decimals."""
    out = F.format_string("%.2f GB", n / float(1 << 30))
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        out = F.when(n < size * 1024, F.format_string(f"%.2f {unit}", n / float(size))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def duration_label(ms: Column) -> Column:
    """X16."""
    long = F.format_string("%dm %.1fs", F.floor(ms / 60000), (ms % 60000) / 1000.0)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.2fs", ms / 1000.0)).otherwise(long)


def xml_escaped(text: Column) -> Column:
    """Five entities, the ampersand first."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
