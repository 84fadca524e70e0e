"""Change streams: files that came, changed or went, in micro-batches, coalesced to one job for each source."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from loomgraph.functions.text import excluded, extension
from loomgraph.sources import files
from loomgraph.sources.connectors import Source

PERIOD = "750 milliseconds"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
log = logging.getLogger(__name__)


def relevant(events: DataFrame, excludes: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """Events that can change the index: no accesses, no empty or climbing paths, nothing excluded, of the extensions if any are given."""
    out = events.where((F.col("kind") != "access") & (F.col("path") != "") & ~F.contains("path", F.lit(".."))).where(~excluded(F.col("path"), excludes))
    return out.where(extension(F.col("path")).isin(*extensions)) if extensions else out


def coalesce(batch: DataFrame) -> DataFrame:
    """Distinct paths of each source: source, path."""
    return batch.select("source", "path").distinct()


# --- listings to changes -----------------------------------------------------------------------------

class _Changes(StatefulProcessor):
    """Holds what the last listing had of a bucket of paths; a listing that lacks a path has lost it.

    The state is a map in the state store, read and written path by path, so a bucket needs no memory for its tree.
    """

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "path string", "mtime long, poll long")
        self.polls = handle.getValueState("polls", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        poll = (self.polls.get()[0] if self.polls.exists() else 0) + 1
        self.polls.update((poll,))
        out: list[tuple[str, str, str]] = []
        source = key[0]
        for batch in rows:
            for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
                if path is None:  # each listing has one such row for each bucket
                    continue
                old = self.known.getValue((path,)) if self.known.containsKey((path,)) else None
                if old is None or old[0] != mtime:
                    out.append((source, path, "create" if old is None else "write"))
                self.known.updateValue((path,), (int(mtime), poll))
            if len(out) > 10_000:
                yield self._frame(out)
                out = []
        for path in [k[0] for k, v in self.known.iterator() if v[1] != poll]:
            self.known.removeKey((path,))
            out.append((source, path, "remove"))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple[str, str, str]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source", "path", "kind"])

    def close(self) -> None:
        pass


def changes(listings: DataFrame, source: str, buckets: int = 16) -> DataFrame:
    """A stream of whole listings(id, mtime) -> a stream of source, path, kind: create, write or remove.

    Paths are kept in `buckets` groups by hash. Every listing must have a row for each of them, or a bucket whose
    last file went would not be looked at: the rows that do so are made from a range, not from the tree.
    """
    spark = listings.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = listings.select(F.col("id").alias("path"), F.unix_micros(F.col("mtime")).alias("mtime"))
    marks = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("mtime")) for b in range(buckets)))
    own = F.array(F.struct(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"), "path", "mtime"))
    # the root's own row, which every listing has, stands for all buckets
    keyed = rows.select(F.explode(F.when(F.col("path") == "", marks).otherwise(own)).alias("r")).select(F.lit(source).alias("source"), "r.*")
    return keyed.groupBy("source", "bucket").transformWithStateInPandas(_Changes(), "source string, path string, kind string", "Update", "None")


# --- jobs --------------------------------------------------------------------------------------------

class DeadLetters:
    """Paths of failed batches, written below a folder until a later batch has done them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        at = self._path(self.folder)
        return [s.getPath().toString() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def add(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/{number}")

    def take(self) -> tuple[DataFrame | None, list[str]]:
        found = [p for p in self._batches() if self._fs.exists(self._path(f"{p}/_SUCCESS"))]
        return (self.spark.read.schema("source string, path string").parquet(*found) if found else None), found

    def drop(self, found: list[str]) -> None:
        for p in found:
            self._fs.delete(self._path(p), True)


def watch(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, dead: str | None = None, excludes: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> StreamingQuery:
    """Runs reindex(paths, batch number) on each micro-batch of events(source, path, kind).

    A batch that fails is written to the folder `dead` (beside the checkpoint by default) and done again along with
    the next one, in this run or after a restart; it goes only when it has succeeded.
    """
    letters = DeadLetters(events.sparkSession, dead or f"{checkpoint.rstrip('/')}-dead")

    def run(batch: DataFrame, number: int) -> None:
        paths = coalesce(batch)
        old, found = letters.take()
        if old is not None:
            paths = paths.unionByName(old).distinct()
        paths = paths.persist()
        try:
            if paths.limit(1).count():
                reindex(paths, number)
            letters.drop(found)
        except Exception:
            log.exception("reindex of batch %d failed; its paths are kept", number)
            letters.add(paths, number)
            letters.drop([f for f in found if not f.endswith(f"/{number}")])
        finally:
            paths.unpersist()

    writer = relevant(events, excludes, extensions).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=PERIOD)).start()


def watchable(spark: SparkSession, sources: list[Source]) -> list[Source]:
    """The sources that have a folder to watch: code and notes whose root is one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = lambda s: (lambda at: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(at))(path(s.root))
    return [s for s in sources if s.kind in ("code", "notes") and folder(s)]


def follow(spark: SparkSession, source: Source, checkpoint: str, reindex: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Watches the folder of a code or note source; see watchable(). The first listing is all new."""
    extensions = ("md",) if source.kind == "notes" else ()
    found = changes(files.listings(spark, source.root, "", source.excludes), source.name)
    return watch(found, reindex, checkpoint, once, excludes=source.excludes, extensions=extensions)


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Distinct-free counts of each hour and type, closed as the watermark passes."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
