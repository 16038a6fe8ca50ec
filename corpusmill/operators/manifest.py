"""The manifest (P7, P8, J3-J5, A4, A18, K5's content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import paths, text


def simhash(docs: DataFrame) -> DataFrame:
    """(path, simhash) as 16 hex digits.

    Each word of three letters or more votes on 64 bits by its SHA-256. The votes are 64
    sums in one aggregate; as a document's words stand together, they are summed before
    the shuffle, which sees a row per document.
    """
    found = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("content", F.lit(""))), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 2)
    hashed = docs.select("path", F.explode(found).alias("w")).select("path", F.conv(F.substring(F.sha2("w", 256), 1, 16), 16, -10).cast("bigint").alias("h"))
    votes = [F.sum(F.getbit("h", F.lit(i)).cast("bigint") * 2 - 1).alias(f"v{i}") for i in range(64)]
    bits = [F.when(F.col(f"v{i}") > 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")) for i in range(64)]
    word = bits[0]
    for b in bits[1:]:
        word = word.bitwiseOR(b)
    voted = hashed.groupBy("path").agg(*votes).select("path", F.lpad(F.lower(F.hex(word)), 16, "0").alias("simhash"))
    return docs.select("path").join(voted, "path", "left").select("path", F.coalesce("simhash", F.lit("0" * 16)).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two simhashes differ."""
    word = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.bit_count(word(a).bitwiseXOR(word(b)))


def relationships(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, outgoing, incoming): sorted arrays of other ends with their anchor text."""
    inside = edges.where("type <> 'external'")
    out = inside.groupBy(F.col("source").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("target").alias("path"), "text"))).alias("outgoing"))
    into = inside.groupBy(F.col("target").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("path"), "text"))).alias("incoming"))
    none = F.array().cast("array<struct<path:string,text:string>>")
    return docs.select("path").join(out, "path", "left").join(into, "path", "left").select("path", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"))


def documents(docs: DataFrame, edges: DataFrame | None = None, tagged: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One row per document with fingerprints, measures, links, tags and chunk ids."""
    c = F.coalesce(F.col("content"), F.lit(""))
    title = F.coalesce(F.col("title"), paths.title(F.col("path"))) if "title" in docs.columns else paths.title(F.col("path"))
    out = docs.select(
        "path", text.document_id(F.col("path"), c).alias("id"), title.alias("title"), paths.section(F.col("path")).alias("section"), F.sha2(c, 256).alias("sha256"),
        F.octet_length(c).alias("size"), text.words(c).alias("word_count"), text.lines(c).alias("line_count"), text.has_code(c).alias("has_code"),
    )
    out = out.join(simhash(docs), "path")
    if edges is not None:
        out = out.join(relationships(docs, edges), "path")
    if tagged is not None:
        out = out.join(tagged.select("path", "tags"), "path", "left")
    if chunks is not None:
        own = chunks.groupBy(F.col("source_path").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
        out = out.join(own, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return out


def statistics(docs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """A4: one row."""
    c = F.coalesce(F.col("content"), F.lit(""))
    words = F.coalesce(F.sum(text.words(c).cast("bigint")), F.lit(0))
    out = docs.agg(
        F.count("*").alias("total_documents"), F.coalesce(F.sum(F.octet_length(c).cast("bigint")), F.lit(0)).alias("total_size"), words.alias("total_words"),
        F.when(F.count("*") > 0, F.floor(words / F.count("*") + 0.5)).otherwise(0).alias("average_words"), F.count_if(text.has_code(c)).alias("with_code"),
    )
    if chunks is not None:
        per = chunks.agg(F.count("*").alias("total_chunks"), F.floor(F.avg("token_count") * 10 + 0.5).alias("x")).select("total_chunks", (F.col("x") / 10).alias("average_chunk_tokens"))
        out = out.crossJoin(per)
    return out


def provenance(origin: str | None = None, repo_ref: str | None = None, generator: str = "corpusmill") -> dict[str, str]:
    """P8."""
    return {k: v for k, v in (("origin", origin), ("repo_ref", repo_ref), ("generator", generator)) if v}
