"""Files as documents.

A directory is listed by the executors into a table, and the files that are wanted are
then read in tasks of many files each. Spark's own source of files keeps every file's
status on the driver and counts each file as 4 MB when it cuts tasks, a few files each.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusmill.functions import paths
from corpusmill.operators import metadata
from corpusmill.session import file_system, scratch

#: Entries after which a task leaves the directories it has found to the next round of tasks.
LISTED_AT_ONCE = 20_000
#: What one task reads: so many bytes, or so many files.
TASK_BYTES, TASK_FILES = 32 << 20, 20_000
#: What one batch of content holds at least before it leaves the worker.
BATCH_BYTES, BATCH_FILES = 8 << 20, 4096
LISTED = "path string, mtime timestamp, size bigint, folder boolean, round int"

#: What counts as a document.
EXTENSIONS = ("md", "mdx", "html")
EXCLUDED = ("build", "coverage", "dist", "node_modules", "out", *("." + t for t in ("git", "output", "netlify", "vercel", "next", "nuxt")))
CODE_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "py", "java", "go", "rs", "rb", "php", "c", "cc", "cpp", "h", "hpp")
CODE_SKIPPED = (
    "__pycache__", "bin", "build", "coverage", "dist", "env", "node_modules", "obj", "out", "target", "temp", "tmp", "vendor", "venv",
)


def check_directory(spark: SparkSession, folder: str) -> None:
    """An error unless ``folder`` exists and is a directory."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)


def is_document(path: Column, extensions: Iterable[str] = EXTENSIONS) -> Column:
    """S3."""
    return F.lower(path).rlike(r"\.(" + "|".join(extensions) + r")\z")


def excluded(path: Column, tokens: Iterable[str] = EXCLUDED, whole_segments: bool = False) -> Column:
    """a token anywhere in the path (so that ``out`` hits ``about``), or as a whole segment."""
    low = F.lower(path)
    hits = [F.array_contains(F.split(low, "/"), t.lower()) if whole_segments else low.contains(t.lower()) for t in tokens]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def matches_globs(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """any of ``include`` (all, if none is given) and none of ``exclude``."""
    any_of = lambda globs: "|".join(paths.glob_to_regex(g) for g in globs)
    include, exclude = list(include), list(exclude)
    out = path.rlike(any_of(include)) if include else F.lit(True)
    return out & ~path.rlike(any_of(exclude)) if exclude else out


def _shown(name: str) -> bool:
    """Spark's rule of the names that a source of files leaves out."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
    return not hidden or name.startswith(("_common_metadata", "_metadata"))


def _entries(system, root: str, folder: str) -> Iterator[tuple[str, str, int | None, int | None, bool]]:
    """(name, path below ``root``, time in microseconds, size, whether a directory) of what is in one directory."""
    full, lead = f"{root}/{folder}" if folder else root, f"{folder}/" if folder else ""
    if system.type_name == "local":
        with os.scandir(full) as found:
            for e in found:
                try:
                    below, s = e.is_dir(), e.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                yield e.name, lead + e.name, s.st_mtime_ns // 1_000_000 * 1000, s.st_size, below
        return
    from pyarrow import fs

    for i in system.get_file_info(fs.FileSelector(full)):
        yield i.base_name, lead + i.base_name, i.mtime_ns and i.mtime_ns // 1_000_000 * 1000, i.size, i.type == fs.FileType.Directory


def listed(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The full name of ``folder``, and a table (path, full_path, mtime, size) of all files below it, for the readers below.

    Rounds of tasks: one lists the directories it is given and goes on into those it
    finds, until it has seen LISTED_AT_ONCE entries; the next round's tasks get the rest.
    """
    check_directory(spark, folder)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(fs_path).toString().rstrip("/")
    most = LISTED_AT_ONCE
    kinds = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("folder", pa.bool_()), ("round", pa.int32())])

    def lister(nth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, name = file_system(root)
            name, rows, seen = name.rstrip("/"), [], 0

            def packed() -> pa.RecordBatch:
                path, mtime, size, below = map(list, zip(*rows)) if rows else ([], [], [], [])
                return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(mtime, pa.int64()).cast(kinds.field("mtime").type), pa.array(size, pa.int64()), pa.array(below, pa.bool_()), pa.array([nth] * len(path), pa.int32())], schema=kinds)

            for batch in batches:
                for given in batch.column(0).to_pylist():
                    # those that it was given are always listed, so that no round is without progress
                    own = [given]
                    while own:
                        for base, path, mtime, size, below in _entries(system, name, own.pop()):
                            if not _shown(base):
                                continue
                            seen += 1
                            if below and seen < most:
                                own.append(path)
                                continue
                            rows.append((path, mtime, size, below))
                            if len(rows) >= 10_000:
                                yield packed()
                                rows.clear()
                        if seen >= most:
                            rows += [(path, None, None, True) for path in own]
                            own = []
            yield packed()

        return run

    table, nth = scratch(spark, "listing"), 0
    open_ = spark.createDataFrame([("",)], "path string")
    while True:
        open_.mapInArrow(lister(nth), LISTED).write.mode("append").parquet(table)
        found = spark.read.schema(LISTED).parquet(table)
        open_ = found.where((F.col("round") == nth) & F.col("folder")).select("path")
        n = open_.count()
        if not n:
            return root, found.where("not folder").select("path", F.concat(F.lit(root + "/"), "path").alias("full_path"), "mtime", "size")
        open_, nth = open_.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)), nth + 1


def _with_content(root: str, rows: DataFrame, skip_corrupt: bool = False) -> DataFrame:
    """Rows of a listing with the files' bytes as ``content``."""
    files, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    at_once = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // TASK_BYTES), -(-files // TASK_FILES), min(4 * at_once, files // 500))
    where, kinds = rows.columns.index("path"), StructType([*rows.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = file_system(root)
        name = name.rstrip("/")

        def content(path: str) -> bytes | None:
            try:
                if system.type_name == "local":
                    with open(f"{name}/{path}", "rb") as source:
                        return source.read()
                with system.open_input_stream(f"{name}/{path}") as source:
                    return source.read()
            except (FileNotFoundError, PermissionError):
                raise
            except OSError:
                if not skip_corrupt:
                    raise
                return None

        for batch in batches:
            own: list[bytes] = []
            kept: list[int] = []
            held = 0
            for i, path in enumerate(batch.column(where).to_pylist()):
                if (data := content(path)) is not None:
                    own.append(data)
                    kept.append(i)
                    held += len(data)
                if held >= BATCH_BYTES or len(own) >= BATCH_FILES or i == batch.num_rows - 1:
                    part = batch.take(pa.array(kept, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], names=[*part.schema.names, "content"])
                    own, kept, held = [], [], 0

    return rows.repartition(tasks, "path").mapInArrow(run, kinds)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every file: path below ``folder``, full_path, mtime, size. Content is not read."""
    return listed(spark, folder)[1]


def scan(
    spark: SparkSession, folder: str, include: Iterable[str] = (), exclude: Iterable[str] = (), tokens: Iterable[str] = EXCLUDED, whole_segments: bool = False,
    keep: Callable[[Column], Column] | None = None, extensions: Iterable[str] = EXTENSIONS, found: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """Text files as (path, full_path, mtime, size, content); predicates run before content is read. ``found``: of ``listed``, if that was done."""
    root, all_ = found or listed(spark, folder)
    rel = F.col("path")
    wanted = is_document(rel, extensions) & ~excluded(rel, tokens, whole_segments) & matches_globs(rel, include, exclude)
    if keep is not None:
        wanted = wanted & keep(rel)
    files = _with_content(root, all_.where(wanted), skip_corrupt=True)
    return files.withColumn("content", F.decode("content", "UTF-8"))


def read_documents(spark: SparkSession, folder: str, default_title: str | None = None, found: tuple[str, DataFrame] | None = None, **scan_options) -> DataFrame:
    """Files as documents (path, original_path, section, title, description, content, metadata, is_html, mtime, raw_size). Every file is read once."""
    found = found or listed(spark, folder)
    of_kind = lambda test: scan(spark, folder, found=(found[0], found[1].where(test)), **scan_options)
    return metadata.documents_of(of_kind(~metadata.is_html(F.col("path"))), of_kind(metadata.is_html(F.col("path"))), default_title)


def root_index(files: DataFrame) -> DataFrame:
    """The first of index.md, index.mdx, index.html at the top, as one row or none."""
    order = metadata.root_order()
    return files.where(order > 0).orderBy(order).limit(1)


def code_files(spark: SparkSession, folder: str, extensions: Iterable[str] = CODE_EXTENSIONS, found: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Source files by exact extension, outside of dot and build directories."""
    root, all_ = found or listed(spark, folder)
    folders = F.split(paths.directory(F.col("path")), "/")
    skipped = F.exists(folders, lambda s: s.startswith(".") | s.isin(*CODE_SKIPPED))
    extension = F.regexp_extract("path", r"\.([^.]+)\z", 1)
    files = _with_content(root, all_.where(extension.isin(*extensions) & ~skipped).select("path", "size", extension.alias("extension")))
    return files.select(F.col("path").alias("file"), "extension", F.decode("content", "UTF-8").alias("content"))


def size_report(files: DataFrame, warn: int = 5 << 20, most: int = 10 << 20) -> DataFrame:
    """Per file its verdict; ``where("verdict <> 'ok'")`` lists the large ones."""
    verdict = F.when(F.col("size") > most, "too_large").when(F.col("size") > warn, "large").otherwise("ok")
    return files.select("path", "size", verdict.alias("verdict"))


def size_statistics(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.avg("size").alias("average")
    )
