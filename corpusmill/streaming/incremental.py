"""Change detection against a stored state.

A state is a table (path, hash, mtime_ms, size). It is replaced by writing a new
version beside the old one; a reader takes the last that is complete.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "path string, hash string, mtime_ms bigint, size bigint"


def state_path(root: str, input_dir: str) -> str:
    """The state's folder: below ``root``, by twelve digits of the input directory's SHA-256."""
    return f"{root.rstrip('/')}/{hashlib.sha256(os.path.abspath(input_dir).encode()).hexdigest()[:12]}"


def snapshot(files: DataFrame) -> DataFrame:
    """The state of files (path, content[, mtime, size])."""
    mtime = F.unix_millis("mtime") if "mtime" in files.columns else F.lit(None).cast("bigint")
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), mtime.alias("mtime_ms"), size.cast("bigint").alias("size"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, hash, mtime_ms, size): added, changed, unchanged, deleted.

    The hash decides. A file whose content could not be read (null hash) counts as
    changed; times and sizes only serve to avoid hashing, see ``suspects``.
    """
    old = before.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("had"))
    new = after.select("path", "hash", "mtime_ms", "size", F.lit(True).alias("has"))
    kind = F.when(F.col("has").isNull(), "deleted").when(F.col("had").isNull(), "added").when(F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("hash").isNotNull(), "unchanged").otherwise("changed")
    return old.join(new, "path", "full_outer").select("path", kind.alias("change"), "hash", "mtime_ms", "size")


def suspects(before: DataFrame, listed: DataFrame) -> DataFrame:
    """Paths of a listing (path, mtime, size) that may have changed: a new path, another time or size."""
    old = before.select("path", F.col("mtime_ms").alias("m"), F.col("size").alias("s"))
    differs = F.col("m").isNull() | (F.unix_millis("mtime") != F.col("m")) | (F.col("size") != F.col("s"))
    return listed.join(old, "path", "left").where(differs).select("path")


def deleted(before: DataFrame, after: DataFrame) -> DataFrame:
    """U3."""
    return before.join(after.select("path"), "path", "left_anti").select("path")


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted((int(p.getName()[1:]), p.toString()) for p in done if p.getName()[:1] == "v" and p.getName()[1:].isdigit())


def load_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last complete state, empty if there is none."""
    found = _versions(spark, folder)
    return spark.read.schema(STATE).parquet(found[-1][1]) if found else spark.createDataFrame([], STATE)


def commit_state(state: DataFrame, folder: str, keep: int = 2) -> None:
    """Write the state as the next version, then drop all but the last ``keep``."""
    spark = state.sparkSession
    found = _versions(spark, folder)
    state.select("path", "hash", "mtime_ms", "size").write.parquet(f"{folder}/v{found[-1][0] + 1 if found else 0}")
    for _, old in found[: max(0, len(found) + 1 - keep)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_state(spark: SparkSession, folder: str) -> None:
    """K17."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def entry(state: DataFrame, path: str) -> DataFrame:
    """S16."""
    return state.where(F.col("path") == path)


def append_versions(changed: DataFrame, folder: str) -> None:
    """Add the changed files' versions (path, hash, size, ts) to the history."""
    changed.select("path", "hash", "size", F.current_timestamp().alias("ts")).write.mode("append").parquet(folder)


def last_versions(history: DataFrame, order: list[str] | None = None, most: int = 50) -> DataFrame:
    """The last ``most`` versions of each path."""
    by = Window.partitionBy("path").orderBy(*(F.desc(c) for c in order or ["ts"]))
    return history.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most).drop("nth")


def history(versions: DataFrame, path: str) -> DataFrame:
    """A path's versions, last first."""
    return versions.where(F.col("path") == path).orderBy(F.desc("ts"))


def statistics(state: DataFrame) -> DataFrame:
    """A22."""
    return state.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.max("mtime_ms").alias("last_mtime_ms"))
