"""Reading back what a build wrote."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunks import SCHEMA
from corpusmill.session import file_system, scratch
from corpusmill.sources import files


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines; lines that are no chunk are skipped."""
    rows = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("chunk_id is not null").drop("_bad")


#: Bytes of a JSON file that one task reads.
RANGE_BYTES = 32 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of a file with the byte at which they start, read by ranges of its bytes."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    size, full, step = system.getFileStatus(name).getLen(), system.makeQualified(name).toString(), RANGE_BYTES
    kinds = pa.schema([("at", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = file_system(full)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with fs.open_input_file(own) as raw:
                    # a line belongs to the range in which it starts
                    at = max(i * step - 1, 0)
                    raw.seek(at)
                    source = io.BufferedReader(raw, 1 << 20)
                    if i:
                        at += len(source.readline())
                    starts, lines, held = [], [], 0
                    while at < (i + 1) * step and (line := source.readline()):
                        starts.append(at)
                        lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                        at, held = at + len(line), held + len(line)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(lines, pa.string())], schema=kinds)
                            starts, lines, held = [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(lines, pa.string())], schema=kinds)

    n = max(1, -(-size // step))
    return spark.range(0, n, 1, n).mapInArrow(run, "at bigint, line string")


def _listed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of array ``name`` where an array's rows are a line each, as ``plans.sinks`` writes them; None of another layout."""
    lines = numbered_lines(spark, path)
    item = F.col("line").rlike(r"\A,?\{.*\}\z") | (F.col("line") == ",")
    edges = lines.where(~item).orderBy("at").limit(1000).collect()
    heads = {m[1]: i for i, e in enumerate(edges) if (m := re.search(r'\A[{,].*?"((?:[^"\\]|\\.)*)": \[\Z', e["line"]))}
    closed = [e["line"] for e in edges[1::2]]
    if sorted(heads.values()) != list(range(0, len(edges), 2)) or not closed or {*closed[:-1]} - {"]"} or closed[-1] != "]}" or name not in heads:
        return None
    first, end = edges[heads[name]]["at"], edges[heads[name] + 1]["at"]
    folder = scratch(spark, "rows")
    own = lines.where((F.col("at") > first) & (F.col("at") < end)).select(F.regexp_replace("line", r"\A,", "").alias("value"))
    own.where("value <> ''").write.text(folder)
    return spark.read.json(folder)


def rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a build: a folder of JSON lines, or the array ``name`` of one JSON file.

    A file with a line for each row is read in ranges by many tasks, one of another layout by one task.
    """
    if not path.endswith(".json"):
        return spark.read.json(path)
    found = _listed(spark, path, name)
    return document(spark, path).select(F.explode(name).alias("x")).select("x.*") if found is None else found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's documents, one row each."""
    return rows(spark, path, "documents")


def document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON artefact (tags, graph) as one row."""
    return spark.read.option("multiLine", "true").json(path)


def from_manifest(spark: SparkSession, manifest_path: str, folder: str) -> DataFrame:
    """Documents that the manifest lists and the directory still has, with the manifest's columns."""
    docs = files.read_documents(spark, folder)
    listed = manifest(spark, manifest_path)
    extra = [c for c in listed.columns if c not in docs.columns]
    return docs.join(listed.select("path", *extra), "path")


def from_directory(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files only."""
    return files.read_documents(spark, folder, extensions=("md", "mdx"), tokens=())


def directory_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """The directory entries a build wrote."""
    return spark.read.json(folder).select(F.col("*"))
