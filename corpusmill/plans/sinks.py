"""Sinks (K1-K16). Files of lines are written in parts by the executors and then joined,
so that a corpus of any size passes through no Python process; tables are written by Spark."""

from __future__ import annotations

import json
import os
import posixpath
import shutil
import tempfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import paths
from corpusmill.operators import documents
from corpusmill.session import file_system as _file_system


def write_text(pieces: Iterable[str], path: str) -> None:
    """One file, under a name of its own until it is whole."""
    fs, name = _file_system(path)
    fs.create_dir(posixpath.dirname(name) or ".", recursive=True)
    with fs.open_output_stream(name + ".partial") as out:
        for piece in pieces:
            out.write(piece.encode())
    fs.move(name + ".partial", name)


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    """A column of sorted rows as one file of lines.

    The executors write the parts. The file system joins them where it can (HDFS); else the
    driver's JVM copies their bytes, in constant memory. No row passes through Python.
    """
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    parts = f"{path}.parts"
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    fs.setWriteChecksum(False)
    df.select(column).write.mode("overwrite").text(parts)
    _join(spark, sorted(s.getPath().toString() for s in fs.listStatus(hadoop.fs.Path(parts)) if s.getPath().getName().startswith("part-")), path)
    fs.delete(hadoop.fs.Path(parts), True)


def _join(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """The bytes of files as one file, under a name of its own until it is whole."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target, whole = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.partial")
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)
    out = fs.create(whole, True)
    try:
        if fs.getScheme() != "hdfs":
            for name in names:
                source = fs.open(hadoop.fs.Path(name))
                hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
    finally:
        out.close()
    if fs.getScheme() == "hdfs" and names:
        sources = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(names))
        for i, name in enumerate(names):
            sources[i] = hadoop.fs.Path(name)
        fs.concat(whole, sources)
    fs.delete(target, True)
    fs.rename(whole, target)


def write_listed(rows: DataFrame, folder: str, between: str = ",") -> None:
    """Rows (file, part, at, key, text) as files of lines below ``folder``, each in the order of its rows, whatever its size.

    ``at``: 0 for a head, 1 for an item, 2 for an end; ``between`` leads an item that follows
    another. A task writes a sorted range of rows. What its first and last file have before and
    after it is not known to it, so these two are parts, which are joined at the end.
    """
    spark = rows.sparkSession
    mark = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _file_system(folder)
        task = f"{TaskContext.get().partitionId():09d}"
        ends: list[tuple[str, str, int, int]] = []
        own = out = None
        first = last = 0

        def close(more: bool) -> None:
            if out is None:
                return
            out.close()
            if more and ends:  # neither the first nor the last
                fs.move(f"{root}/{own}.{task}", f"{root}/{own}")
            else:
                ends.append((own, task, first, last))

        for batch in batches:
            for file, at, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != own:
                    close(True)
                    own, first, last = file, at, -1
                    fs.create_dir(posixpath.dirname(f"{root}/{file}"), recursive=True)
                    out = fs.open_output_stream(f"{root}/{file}.{task}")
                out.write((mark if at == 1 and last == 1 else b"") + text.encode() + b"\n")
                last = at
        close(False)
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "task", "first", "last"), e)) for e in ends], pa.schema([("file", pa.string()), ("task", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    ordered = rows.orderBy("file", "part", "at", "key", "text").select("file", "at", "text")
    parts = sorted(tuple(r) for r in ordered.mapInArrow(run, "file string, task string, first int, last int").collect())
    fs, root = _file_system(folder)
    for file, own in groupby(parts, key=lambda p: p[0]):
        names, before = [], -1
        for _, task, first, last in own:
            if mark and before == first == 1:
                names.append(f"{file}.{task}.between")
                with fs.open_output_stream(f"{root}/{names[-1]}") as out:
                    out.write(mark)
            names.append(f"{file}.{task}")
            before = last
        if len(names) == 1:
            fs.move(f"{root}/{names[0]}", f"{root}/{file}")
            continue
        _join(spark, [f"{folder}/{n}" for n in names], f"{folder}/{file}")
        for n in names:
            if fs.get_file_info(f"{root}/{n}").is_file:  # HDFS has joined them in place
                fs.delete_file(f"{root}/{n}")


def write_rows(df: DataFrame, path: str, column: str = "text", end: str = "") -> None:
    """A column of sorted rows as one file: of lines, or of one text."""
    if end == "\n":
        write_lines(df, path, column)
    else:
        write_text((r[0] + end for r in df.select(column).toLocalIterator(prefetchPartitions=True)), path)


def write_json(value: object, path: str) -> None:
    write_text([json.dumps(value, ensure_ascii=False, indent=2) + "\n"], path)


def write_row_json(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    write_text((r[0] + "\n" for r in df.select(F.to_json(F.struct("*"))).limit(1).collect()), path)


def write_jsonl(df: DataFrame, folder: str) -> None:
    """K6: JSON lines, one file per partition."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(folder)


def write_document(parts: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str) -> None:
    """One JSON file: an object with an array for each name, of a table's rows in the order of its columns.

    Every row is a line, written by the executors; a comma leads all rows but an array's first.
    """
    spark = next(iter(parts.values()))[0].sparkSession
    lines, schema = [], "part int, at int, key array<string>, text string"
    for i, (name, (rows, order)) in enumerate(parts.items()):
        key = F.array(*(F.col(c).cast("string") for c in order))
        own = rows.select(F.lit(i).alias("part"), F.lit(1).alias("at"), key.alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("text"))
        least = own.agg(F.min(F.struct("key", "text")).alias("m")).first()["m"]
        lead = F.lit(False) if least is None else (F.col("key") == F.array(*(F.lit(x) for x in least["key"]))) & (F.col("text") == least["text"])
        lines.append(own.withColumn("text", F.when(lead, F.col("text")).otherwise(F.concat(F.lit(","), "text"))))
        edges = [(i, 0, None, ("{" if i == 0 else ",") + f"{json.dumps(name)}: ["), (i, 2, None, "]" + ("}" if i == len(parts) - 1 else ""))]
        lines.append(spark.createDataFrame(edges, schema))
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    write_lines(whole.orderBy("part", "at", "key", "text"), path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Rows (path, content) as files below ``folder``, written by the executors; their number.

    On a local disk each task makes its files in a hidden folder of its own and moves them,
    as tasks that make files in one folder wait for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        made: set[str] = set()
        parts = ""
        if fs.type_name == "local":
            os.makedirs(root, exist_ok=True)
            parts = tempfile.mkdtemp(prefix=".parts-", dir=root)
        try:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    name = posixpath.join(root, path)
                    if (above := posixpath.dirname(name)) not in made:
                        fs.create_dir(above, recursive=True)
                        if len(made) > 10_000:
                            made.clear()
                        made.add(above)
                    with open(f"{parts}/own", "wb") if parts else fs.open_output_stream(name) as out:
                        out.write((content or "").encode())
                    if parts:
                        os.replace(f"{parts}/own", name)
                yield batch.select([0])
        finally:
            if parts:
                shutil.rmtree(parts, ignore_errors=True)

    # a small table may be a partition or two, however many files it makes
    return rows.select("path", "content").repartition("path").mapInArrow(run, "path string").count()


def index_lines(ordered: DataFrame, site: dict, base_url: str | None = None, with_optional: bool = True) -> DataFrame:
    """K2: (text) lines of the index file, sorted. ``ordered``: of ``documents.ordered``."""
    has = lambda c: c in ordered.columns
    title = F.coalesce(F.col("title"), paths.title(F.col("path"))) if has("title") else paths.title(F.col("path"))
    notes = F.coalesce(F.col("description"), F.lit("")) if has("description") else F.lit("")
    shown = F.coalesce("original_path", "path") if has("original_path") else F.col("path")
    line = F.concat(F.lit("- ["), title, F.lit("]("), paths.absolute_url(shown, base_url), F.lit(")"), F.when(notes != "", F.concat(F.lit(": "), notes)).otherwise(""))
    rows = ordered if with_optional else ordered.where("not is_optional")
    name = F.when(F.col("is_optional"), F.lit("Optional")).otherwise(F.col("section"))
    part = [F.col("is_optional").alias("o"), F.when(F.col("is_optional"), False).otherwise(F.col("section") != "Root").alias("r"), name.alias("s")]
    items = rows.select(*part, F.lit(1).alias("k"), F.col("priority").alias("p"), "path", line.alias("text"))
    heads = rows.select(*part).distinct().select("o", "r", "s", F.lit(0).alias("k"), F.lit(0).alias("p"), F.lit("").alias("path"), F.concat(F.lit("\n## "), "s", F.lit("\n")).alias("text"))
    top = [f"# {site['title']}", "", f"> {site['description']}"] + (["", site["instructions"]] if site.get("instructions") else [])
    spark = ordered.sparkSession
    first = spark.createDataFrame([(False, False, "", -1, i, "", t) for i, t in enumerate(top)], "o boolean, r boolean, s string, k int, p int, path string, text string")
    return first.unionByName(heads).unionByName(items).orderBy("o", F.when(F.col("k") < 0, False).otherwise(True), "r", "s", "k", "p", "path").select("text")


def full_entry() -> Column:
    """K3."""
    return F.concat(F.lit("## "), "path", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n"))


def write_llms(ordered: DataFrame, site: dict, folder: str, base_url: str | None = None) -> None:
    """K1, K3: llms.txt, llms-ctx.txt (without the optional section), llms-ctx-full.txt, llms-full.txt."""
    whole = index_lines(ordered, site, base_url)
    for name in ("llms.txt", "llms-ctx-full.txt"):
        write_rows(whole, f"{folder}/{name}", end="\n")
    write_rows(index_lines(ordered, site, base_url, False), f"{folder}/llms-ctx.txt", end="\n")
    write_rows(ordered.orderBy(*documents.order_keys()).select(full_entry().alias("text")), f"{folder}/llms-full.txt", end="\n")


def write_legacy(docs: DataFrame, folder: str) -> None:
    """K4: the three classes in locale order, as Root, Documentation and the rest."""
    name = F.element_at(F.array(F.lit("Root"), F.lit("Documentation"), F.lit("Optional")), F.col("class") + 1)
    rows = documents.legacy_ordered(docs).select(F.concat(F.lit("- "), name, F.lit(": "), "path").alias("text"))
    write_rows(rows, f"{folder}/llms-legacy.txt", end="\n")


def tags_json(tagged: DataFrame) -> DataFrame:
    """K7: {path: tags} as one row of JSON; for large corpora write the long form instead."""
    return tagged.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "tags")))).alias("documents"))


def symbols_text(found: DataFrame) -> DataFrame:
    """(text) lines of all symbols by file, sorted."""
    return found.orderBy("file", "line", "kind", "name").select(F.concat_ws(" ", F.concat("file", F.lit(":"), F.col("line").cast("string")), "kind", "name").alias("text"))
