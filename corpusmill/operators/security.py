"""Security audit of contents, paths and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths

SCRIPT = r"(?is)<script[^>]*>.*?</script>|javascript:|vbscript:|data:text/html|on(?:load|error|click)\s*="
SUSPICIOUS = ("0.0.0.0", "127.0.0.1", "bit.ly", "file://", "ftp://", "goo.gl", "localhost", "t.co", "tinyurl.com")
BLOCKED = ("..", ".env", ".git", "confidential", "node_modules", "private", "secrets")
ALLOWED, FORBIDDEN = ("html", "json", "md", "mdx", "txt"), ("bat", "cmd", "exe", "ps1", "sh")
MOST_BYTES, MOST_FILES, MOST_PATH = 100 << 20, 10_000, 4096


def suspicious_url(url: Column) -> Column:
    """a known shortener or local address, an IPv4 address, or a character eleven times in a row."""
    low = F.lower(url)
    out = low.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+") | low.rlike(r"(.)\1{10,}")
    for part in SUSPICIOUS:
        out = out | low.contains(part)
    return out


def urls(docs: DataFrame) -> DataFrame:
    """(path, pos, url, suspicious) of all web addresses in a text."""
    found = docs.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"""(?i)https?://[^\s<>"]+"""), F.lit(0))).alias("pos", "url"))
    return found.select("path", "pos", "url", suspicious_url(F.col("url")).alias("suspicious"))


def content_issues(docs: DataFrame) -> DataFrame:
    """(path, type, detail): scripts (once), suspicious addresses, runs of over 1000 base64 characters."""
    c = F.coalesce(F.col("content"), F.lit(""))
    row = lambda kind, detail: F.struct(F.lit(kind).alias("type"), detail.alias("detail"))
    kind = "array<struct<type:string,detail:string>>"
    bad = F.filter(F.regexp_extract_all(c, F.lit(r"""(?i)https?://[^\s<>"]+"""), F.lit(0)), suspicious_url)
    digit = r"[\da-zA-Z/+]"
    long = F.regexp_extract_all(c, F.lit(f"(?:{digit}{{4}}){{251,}}(?:{digit}{{3}}=|{digit}{{2}}==)?"), F.lit(0))
    found = F.concat(
        F.when(c.rlike(SCRIPT), F.array(row("script_injection", F.lit("")))).otherwise(F.array().cast(kind)), F.transform(bad, lambda u: row("suspicious_url", u)),
        F.transform(long, lambda s: row("large_base64", F.length(s).cast("string"))),
    )
    return docs.select("path", F.explode(found).alias("x")).select("path", "x.type", "x.detail")


def path_issues(files: DataFrame, allowed_prefixes: tuple[str, ...] = (), blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(path, type): too long, NUL, suspicious characters, parent steps, blocked segments, outside the prefixes."""
    p = F.col("path")
    inside = F.lit(not allowed_prefixes)
    for prefix in allowed_prefixes:
        inside = inside | p.startswith(prefix)
    segments = F.split(F.lower(p), "/")
    found = F.array_compact(F.array(
        F.when(F.length(p) > MOST_PATH, "path_too_long"), F.when(p.contains("\x00"), "nul_character"), F.when(p.rlike(r"""[<>"|?*\x01-\x1F]"""), "suspicious_character"),
        F.when(F.array_contains(segments, ".."), "parent_step"), F.when(F.arrays_overlap(segments, F.array(*map(F.lit, blocked))), "blocked_segment"), F.when(~inside, "outside_prefixes"),
    ))
    return files.select("path", F.explode(found).alias("type"))


def file_issues(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, type) by size and extension of files (path, size)."""
    extension = F.lower(F.substring(paths.extension(F.col("path")), 2, 64))
    found = F.array_compact(F.array(
        F.when(F.col("size") > most_bytes, "file_too_large"), F.when(extension.isin(*FORBIDDEN), "forbidden_extension").when(~extension.isin(*ALLOWED), "unknown_extension"),
    ))
    return files.select("path", F.explode(found).alias("type"))


def crowded_directories(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(directory, files) with more than ``most`` files."""
    return files.groupBy(paths.directory(F.col("path")).alias("directory")).agg(F.count("*").alias("files")).where(F.col("files") > most)


def audit(docs: DataFrame) -> DataFrame:
    """(path, verdict, issues) of documents (path, content); the verdict is safe, unsafe, or error for a text that could not be read."""
    sized = docs.select("path", F.octet_length(F.coalesce("content", F.lit(""))).alias("size"))
    found = content_issues(docs).select("path", "type").unionByName(path_issues(docs)).unionByName(file_issues(sized))
    own = found.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("issues"))
    verdict = F.when(F.col("content").isNull(), "error").when(F.size(F.coalesce("issues", F.array())) > 0, "unsafe").otherwise("safe")
    return docs.join(own, "path", "left").select("path", verdict.alias("verdict"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row; the score is the share of safe files in percent, halves up, 100 without files."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    score = F.when(F.count("*") > 0, F.floor(n("safe") * 100 / F.count("*") + 0.5)).otherwise(100)
    return audited.agg(F.count("*").alias("total"), n("safe").alias("safe"), n("unsafe").alias("unsafe"), n("error").alias("errors"), score.cast("int").alias("score"))
