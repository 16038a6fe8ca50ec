"""Watch mode on Structured Streaming.

A file source reports a file once, and neither an edit nor a deletion, so the stream
is a clock: each micro-batch lists the directory (paths, times and sizes; no content).
A listing that differs from the one before restarts the wait; when it has stayed the
same for one interval and differs from the stored state, that is one batch of changes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.session import cut, drop_cut
from corpusmill.sources import files
from corpusmill.streaming import incremental


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """Events (watch_root, path, ts, event) in sessions that a quiet ``gap`` ends.

    One row per session: watch_root, first_at, last_at, events, and the last event of
    each path as a map. Works on streams too, where ``late`` sets the watermark.
    """
    rows = events.withWatermark("ts", late) if late else events
    session = F.session_window("ts", gap)
    own = rows.groupBy(session.alias("s"), "watch_root").agg(F.count("*").alias("events"), F.collect_list(F.struct("path", "ts", "event")).alias("all"))
    # sorted by path and time, a path's last event is the one before another path
    own = own.withColumn("all", F.array_sort("all"))
    last = F.filter("all", lambda x, i: (i == F.size("all") - 1) | (x["path"] != F.get("all", i + 1)["path"]))
    own = own.withColumn("last", F.map_from_arrays(F.transform(last, lambda x: x["path"]), F.transform(last, lambda x: x["event"])))
    return own.select("watch_root", F.col("s.start").alias("first_at"), F.col("s.end").alias("closed_at"), "events", "last")


def relevant(events: DataFrame, output_dir: str = "", extensions: Iterable[str] = files.EXTENSIONS) -> DataFrame:
    """F16: events of documents that are not below the output directory; an empty one excludes nothing."""
    out = events.where(files.is_document(F.col("path"), extensions))
    prefix = output_dir.strip("/")
    return out.where(~F.col("path").startswith(prefix + "/")) if prefix not in ("", ".") else out


class Watcher:
    """Rebuilds when the directory changes. ``build`` gets (spark, changes, batch id)."""

    def __init__(self, spark: SparkSession, folder: str, state: str, build: Callable[[SparkSession, DataFrame, int], None], output_dir: str = "", emit: Callable[[str], None] | None = None):
        self.spark, self.folder, self.state, self.build, self.output_dir = spark, folder, state, build, output_dir
        self.emit = emit or (lambda line: print(line, flush=True))
        self.query: StreamingQuery | None = None
        self.counts = {"rebuilds": 0, "failures": 0}
        self.seen: tuple | None = None
        self.built: tuple | None = None

    def say(self, event: str, **fields: object) -> None:
        """K19, R9."""
        self.emit(json.dumps({"event": event, "at": round(time.time(), 3)} | fields))

    def start(self, checkpoint: str, interval: str = "500 milliseconds") -> StreamingQuery:
        """Looks at the directory once per interval; a quiet interval after a change ends the wait."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", "10").load()
        writer = clock.writeStream.foreachBatch(lambda df, i: self.look(i)).option("checkpointLocation", checkpoint)
        self.query = writer.trigger(processingTime=interval).start()
        self.say("watch_started", folder=self.folder)
        return self.query

    def listed(self) -> tuple:
        """The number of documents and a fingerprint of their paths, times and sizes."""
        every = files.listing(self.spark, self.folder)
        rows = relevant(every, self.output_dir)
        try:
            return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("path", "mtime", "size").cast("decimal(38,0)"))).first())
        finally:
            drop_cut(every)

    def look(self, batch: int) -> bool:
        """Rebuild if the directory has changed and then been quiet since the last look."""
        try:
            now = self.listed()
        except Exception as error:  # noqa: BLE001 - a file may go while the directory is read
            self.say("watch_error", error=str(error)[:500])
            return False
        if now != self.seen:  # the wait starts again
            self.seen = now
            return False
        if now == self.built:
            return False
        done = self.rebuild(batch)
        if done is not None:
            self.built = now
        return bool(done)

    def rebuild(self, batch: int) -> bool | None:
        """Build what changed and commit the state; a failure (None) is reported and tried again at the next look."""
        try:
            old = incremental.load_state(self.spark, self.state)
            every = files.listed(self.spark, self.folder)
            now = relevant(files.scan(self.spark, self.folder, found=every), self.output_dir)
            # written before the build, so that an edit during the build is a change at the next look
            found = cut(incremental.changes(old, incremental.snapshot(now)))
            drop_cut(every[1])
            changed = found.where("change <> 'unchanged'")
            n = changed.count()
            if not n:
                return False
            self.say("changes_detected", files=n)
            self.say("rebuild_started", batch=batch)
            self.build(self.spark, changed, batch)
            incremental.commit_state(found.where("change <> 'deleted'"), self.state)
            drop_cut(found)
            self.counts["rebuilds"] += 1
            self.say("rebuild_completed", batch=batch)
            return True
        except Exception as error:  # noqa: BLE001 - the watch goes on, as the next batch may succeed
            self.counts["failures"] += 1
            self.say("rebuild_failed", batch=batch, error=str(error)[:500])
            return None

    def force(self) -> bool:
        """R5."""
        self.say("force_rebuild_requested")
        incremental.clear_state(self.spark, self.state)
        return bool(self.rebuild(-1))

    def status(self) -> dict:
        """R6."""
        active = bool(self.query and self.query.isActive)
        error = str(self.query.exception()) if self.query and self.query.exception() else None
        if error:
            self.say("watch_error", error=error[:500])
        return {"active": active, "error": error, **self.counts}

    def stop(self) -> None:
        if self.query:
            self.query.stop()
        self.say("watch_stopped")
