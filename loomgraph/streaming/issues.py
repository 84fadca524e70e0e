"""Issue updates as a stream: each batch is what was updated since the minute that the last one has reached."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from loomgraph.jobs.index import Settings, Source, index
from loomgraph.operators.store import Store
from loomgraph.sources import services

ITEMS = pa.schema([("page", pa.string()), ("ord", pa.int64()), ("item", pa.string())])


def moment(raw: str | None) -> datetime | None:
    """Time of an update as the service writes it; None if it can't be read."""
    try:
        at = datetime.fromisoformat(raw or "")
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def minute(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%d %H:%M")


class IssueUpdates(DataSource):
    """Format `issue_updates`: option root, a folder of recorded pages; option since, the minute to go on from.

    The offset is the minute of the latest update seen. Queries of the service have that precision, so the issues
    of the start's minute are read again; hashes tell which of them are old. Issues whose time can't be read are
    of the first batch alone. Pages are partitions, read where the task is.
    """

    @classmethod
    def name(cls) -> str:
        return "issue_updates"

    def schema(self) -> str:
        return "page string, ord long, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Updates(self.options["root"], self.options.get("since") or "")


class _Page(InputPartition):
    def __init__(self, path: str, start: str, end: str):
        self.path, self.start, self.end = path, start, end


class _Updates(DataSourceStreamReader):
    def __init__(self, root: str, since: str):
        self.root, self.since = root, since[:16]

    def _pages(self) -> tuple[fs.FileSystem, list[str]]:
        system, root = fs.FileSystem.from_uri(self.root)
        return system, sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.path.endswith(".json"))

    @staticmethod
    def _items(system: fs.FileSystem, path: str) -> list[dict]:
        with system.open_input_stream(path) as f:
            page = json.loads(f.read())
        return next((page[k] for k in ("items", "issues", "results") if k in page), [])

    @staticmethod
    def _updated(item: dict) -> datetime | None:
        return moment((item.get("fields") or {}).get("updated"))

    def initialOffset(self) -> dict:
        return {"minute": self.since}

    def latestOffset(self) -> dict:
        """The latest update among the pages, one at a time; a live service answers that with its newest issue."""
        system, pages = self._pages()
        latest = max((minute(at) for p in pages for i in self._items(system, p) if (at := self._updated(i))), default=self.since)
        return {"minute": max(latest, self.since)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p, start["minute"], end["minute"]) for p in self._pages()[1]]

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        rows = []
        for n, item in enumerate(self._items(system, partition.path)):
            at = self._updated(item)
            if partition.start <= minute(at) <= partition.end if at else not partition.start:
                rows.append({"page": partition.path.rsplit("/", 1)[-1], "ord": n, "item": json.dumps(item)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ITEMS)

    def commit(self, end: dict) -> None:
        pass


def follow(spark: SparkSession, store: Store, source: Source, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Indexes the updates of an issue source as they come; starts at the cursor in the store, which each batch moves on."""
    spark.dataSource.register(IssueUpdates)
    found = spark.readStream.format("issue_updates").options(root=source.root, since=store.meta(f"issues.{source.name}.updated") or "").load()

    def run(batch: DataFrame, number: int) -> None:
        index(spark, store, [source], settings, given={source.name: services.issue_documents(batch, source.url)})

    writer = found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
