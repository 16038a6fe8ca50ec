"""Session helpers: builder with the settings the plans are written for, and
the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, app: str = "corpusmill", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local mode, tests) a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set on this cluster")
    named = os.path.join(tempfile.gettempdir(), f"corpusmill-{os.getuid()}")
    os.makedirs(named, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def file_system(path: str):
    """(file system, name in it) of a path or an address, for the driver and the workers alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, which goes when this process ends.

    What a query writes there may be read as long as its result can be, and no longer:
    ``release`` lets all of it go at once.
    """
    if not _scratch:
        atexit.register(release)
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def release() -> None:
    """Remove every folder that ``scratch`` gave out; for when all results are written."""
    while _scratch:
        try:
            system, name = file_system(_scratch.pop())
            system.delete_dir(name)
        except OSError:  # gone already
            pass


class Shared:
    """A broadcast of an object of any class; workers need no copy of its package."""

    def __init__(self, spark: SparkSession, value: object):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        held = getattr(self._packed, "_loaded", None)
        if held is None:
            held = self._packed._loaded = pickle.loads(self._packed.value)
        return held


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written as a table in the shared folder and read again.

    Unlike a checkpoint it is computed once, is compressed, and has statistics for
    the planner. A lost executor costs the tasks that read it, not its computation.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut`` that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
