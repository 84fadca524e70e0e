"""One interface over all kinds of sources: work items with hashes, and what is extracted of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.sources import files, services

DOC = "struct<title:string,aliases:array<string>,tags:array<string>,body:string>"
ITEM = ("source", "path", "kind", "language", "hash", "updated", "content", "doc")


@dataclass(frozen=True)
class Source:
    """root: a folder of files or of recorded pages; url: address of the service, for links."""

    name: str
    kind: str
    root: str
    languages: tuple[str, ...] = ()
    url: str = ""
    excludes: tuple[str, ...] = files.EXCLUDES


class Connector(ABC):
    """Items of a source: ITEM columns. `delta` says that a scan since a cursor shows changes only, never removals."""

    kind = ""
    delta = False

    @abstractmethod
    def scan(self, spark: SparkSession, source: Source, only: DataFrame | None = None, since: str | None = None) -> DataFrame:
        """only: ids to look at; since: minute of the last run's latest update."""

    def items(self, spark: SparkSession, source: Source, only: DataFrame | None = None, since: str | None = None) -> DataFrame:
        return self.shaped(self.scan(spark, source, only, since), source)

    def shaped(self, found: DataFrame, source: Source) -> DataFrame:
        found = found.withColumns({"source": F.lit(source.name), "kind": F.lit(self.kind)})
        blank = {"language": "string", "content": "binary", "doc": DOC}
        return found.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in found.columns}).select(*ITEM)


class CodeFiles(Connector):
    kind = "code"

    def scan(self, spark, source, only=None, since=None):
        return files.code_files(spark, source.root, list(source.languages), source.excludes, only).select(F.col("id").alias("path"), "language", "hash", F.col("mtime").alias("updated"), "content")


class NoteFiles(Connector):
    kind = "notes"

    def scan(self, spark, source, only=None, since=None):
        return files.notes(spark, source.root, source.excludes, only).select(F.col("id").alias("path"), "hash", F.col("mtime").alias("updated"), "content")


def documents(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Documents of a service as items."""
    doc = F.struct("title", "aliases", "tags", "body").alias("doc")
    found = docs.select("path", "hash", "updated", doc)
    return found if only is None else found.join(only.select(F.col("id").alias("path")).distinct(), "path", "left_semi")


class Issues(Connector):
    kind, delta = "issues", True

    def scan(self, spark, source, only=None, since=None):
        docs = services.issue_documents(services.items(spark, source.root), source.url)
        return documents(docs if since is None else services.updated_since(docs, since), only)


class WikiPages(Connector):
    kind = "wiki"

    def scan(self, spark, source, only=None, since=None):
        return documents(services.wiki_documents(services.items(spark, source.root), source.url), only)


class WorkspacePages(Connector):
    kind = "workspace"

    def scan(self, spark, source, only=None, since=None):
        return documents(services.workspace_documents(services.items(spark, source.root)), only)


CONNECTORS: dict[str, Connector] = {c.kind: c for c in (CodeFiles(), NoteFiles(), Issues(), WikiPages(), WorkspacePages())}


def note_fields(raw: DataFrame, raw_column: str, path: str | Column) -> DataFrame:
    """raw with title, aliases, tags, body and links of a note in place of its text.

    The text's line ends, its front matter and its body are columns of their own before anything is taken from
    them: expressions that are used more than once are not inlined, so each is computed once.
    """
    block = r"(?s)^---\n(.*?)\n---(?:\n|$)"
    path = F.col(path) if isinstance(path, str) else path
    d = raw.withColumn("_text", F.regexp_replace(raw_column, "\r\n", "\n")).drop(raw_column)
    d = d.withColumn("_front", F.regexp_extract("_text", block, 0))
    d = d.withColumns({"_head": F.when(F.col("_front") != "", F.regexp_extract("_front", block, 1)), "body": F.substring("_text", F.length("_front") + 1, F.length("_text"))}).drop("_text", "_front")
    head, body = F.col("_head"), F.col("body")
    return d.withColumns({
        "title": F.coalesce(text.head_value(head, "title"), text.first_heading(body), text.stem(path)), "aliases": text.head_list(head, "aliases"),
        "tags": F.array_distinct(F.concat(text.head_list(head, "tags"), text.inline_tags(body))), "links": text.wikilinks(body),
    }).drop("_head")
