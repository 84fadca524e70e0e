"""Source trees and note vaults as DataFrames of work items: id, path, hash, mtime, content."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomgraph.functions.text import excluded, extension, language

#: Folders that are never indexed, and files whose lines name more that isn't.
EXCLUDES = ("**/node_modules/**", "**/target/**", "**/.git/**", "**/vendor/**")
IGNORE_FILES = (".gitignore", ".ignore")
#: What may be a source file of a known language.
CODE = r"\.(?:rs|tsx?|py|rb|rake|gemspec)$|(?:^|/)(?:Rakefile|Gemfile)$"


TREE = pa.schema([("id", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("content", pa.binary())])


class SourceTree(DataSource):
    """Format `source_tree`: files below a folder as id, mtime, content.

    Spark's own file readers pass over names that begin with `_` or `.`, which are half the modules of a Python
    package and all ignore files. Options: root; open, a regular expression on ids of what is read; excludes, a
    JSON list; ids, a JSON list of ids to read instead of all; bare, to leave contents closed. Folders of the
    first two levels are partitions, and each walks what is below it. Any file system of Arrow will do.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "id string, mtime timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreePolls(dict(self.options))


class _Walk(InputPartition):
    def __init__(self, folder: str | None, deep: bool, ids: list[str] | None = None):
        self.folder, self.deep, self.ids = folder, deep, ids


class _TreeReader(DataSourceReader):
    IDS, BYTES = 1000, 1 << 23

    def __init__(self, options: dict[str, str]):
        self.options = {k: options.get(k) for k in ("root", "open", "excludes", "ids", "bare")}
        self.like = re.compile(self.options["open"] or "")
        self.excludes = [p for p in (x.strip("*/") for x in json.loads(self.options["excludes"] or "[]")) if p]

    def _fs(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.options["root"])
        return system, root.rstrip("/")

    def _entries(self, system: fs.FileSystem, root: str, folder: str) -> tuple[list[str], list[tuple[str, object]]]:
        """Folders in a folder that aren't excluded, and its files."""
        infos = system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
        named = [(i.path[len(root) + 1 :], i) for i in infos]
        return [n for n, i in named if i.type == fs.FileType.Directory and not any(x in f"/{n}/" for x in self.excludes)], [(n, i) for n, i in named if i.type == fs.FileType.File]

    def partitions(self) -> list[InputPartition]:
        if self.options["ids"] is not None:
            ids = json.loads(self.options["ids"])
            return [_Walk(None, False, ids[i : i + self.IDS]) for i in range(0, len(ids), self.IDS)] or [_Walk(None, False, [])]
        system, root = self._fs()
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise ValueError(f"no folder at {self.options['root']}")
        first = self._entries(system, root, "")[0]
        return [_Walk("", False), *(_Walk(f, False) for f in first), *(_Walk(g, True) for f in first for g in self._entries(system, root, f)[0])]

    def _files(self, system: fs.FileSystem, root: str, p: _Walk) -> Iterator[tuple[str, object]]:
        if p.ids is not None:
            infos = system.get_file_info([f"{root}/{i}" for i in p.ids])
            yield from ((n, i) for n, i in zip(p.ids, infos, strict=True) if i.type == fs.FileType.File)
            return
        left = [p.folder]
        while left:
            folders, files = self._entries(system, root, left.pop())
            yield from files
            left += folders if p.deep else []

    def read(self, partition: _Walk) -> Iterator[pa.RecordBatch]:
        system, root = self._fs()
        rows, size, bare = [], 0, self.options["bare"] is not None
        for id_, info in self._files(system, root, partition):
            if not self.like.search(id_):
                continue
            content = None
            if not bare:
                with system.open_input_stream(info.path) as f:
                    content = f.read()
            rows.append({"id": id_, "mtime": info.mtime, "content": content})
            size += len(content or b"") + 200
            if size > self.BYTES:
                yield pa.RecordBatch.from_pylist(rows, TREE)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, TREE)


class _TreePolls(DataSourceStreamReader):
    """Each batch is one listing of the whole tree: id and mtime of every file."""

    def __init__(self, options: dict[str, str]):
        self.walks = _TreeReader(options | {"bare": "1"})

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.walks.partitions()

    def read(self, partition: _Walk) -> Iterator[pa.RecordBatch]:
        if partition.folder == "":  # the root itself, so that a listing of no files is one, too
            yield pa.RecordBatch.from_pylist([{"id": "", "mtime": datetime.fromtimestamp(0, UTC)}], TREE)
        yield from self.walks.read(partition)

    def commit(self, end: dict) -> None:
        pass


def tree(spark: SparkSession, root: str, open_: str = "", excludes: tuple[str, ...] = EXCLUDES, **more: str) -> DataFrame:
    """id, mtime and content of the files below root whose ids fit the regular expression."""
    spark.dataSource.register(SourceTree)
    options = {"root": root.rstrip("/"), "open": open_, "excludes": json.dumps(excludes), **more}
    return spark.read.format("source_tree").options(**options).load()


def listings(spark: SparkSession, root: str, open_: str = "", excludes: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """A stream whose batches are listings of the files below root: id, mtime, content (null); the root itself has a row of an empty id."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").options(root=root.rstrip("/"), open=open_, excludes=json.dumps(excludes)).load()


def scan(spark: SparkSession, root: str, excludes: tuple[str, ...] = EXCLUDES, only: DataFrame | None = None, open_: str = "") -> DataFrame:
    """All files below root, or those of the ids in only (one batch of changes) that exist; ids are relative, with `/`."""
    more = {} if only is None else {"ids": json.dumps(sorted({r.id for r in only.select("id").distinct().collect()}))}
    files = tree(spark, root, open_, excludes, **more).select("id", F.sha2("content", 256).alias("hash"), "mtime", "content")
    return files.where(~excluded(F.concat(F.lit("/"), F.col("id")), excludes))


def ignore_rules(spark: SparkSession, root: str, excludes: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """Rules of all ignore files below root: folder, file, ord, pattern (regular expression on ids), keep, only_folders."""
    names = "|".join(re.escape(n) for n in IGNORE_FILES)
    files = tree(spark, root, rf"(?:^|/)(?:{names})$", excludes).select("id", F.decode("content", "UTF-8").alias("text"))
    lines = files.select(F.regexp_replace("id", "/?[^/]*$", "").alias("folder"), F.regexp_extract("id", "([^/]*)$", 1).alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("ord", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    rule = F.regexp_replace(F.regexp_replace("line", "^!", ""), r"^\\([#!])", "$1")
    return lines.select("folder", "file", "ord", F.startswith("line", F.lit("!")).alias("keep"), F.endswith("line", F.lit("/")).alias("only_folders"), _pattern(F.regexp_replace(rule, "/+$", ""), F.col("folder")).alias("pattern")).where("pattern is not null")


def _pattern(rule: Column, folder: Column) -> Column:
    """A rule as a regular expression on whole ids: with a slash it holds from its folder, else at any depth below it."""
    quoted = F.regexp_replace(rule, r"[.+^$(){}|]", r"\\$0")
    stars = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"^/?\*\*/", "\x01"), r"/\*\*/", "\x02"), r"/\*\*$", "\x03")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(stars, r"\*+", "[^/]*"), r"\?", "[^/]"), r"\[!", "[^")
    glob = F.regexp_replace(F.regexp_replace(F.regexp_replace(glob, "\x01", "(?:.*/)?"), "\x02", "/(?:.*/)?"), "\x03", "/.*")
    base = F.when(folder == "", "").otherwise(F.concat(F.regexp_replace(folder, r"[.+^$(){}|\[\]*?\\]", r"\\$0"), F.lit("/")))
    anywhere = ~F.contains(rule, F.lit("/"))
    return F.when(rule != "", F.concat(F.lit("^"), base, F.when(anywhere, "(?:.*/)?").otherwise(""), F.regexp_replace(glob, "^/", ""), F.lit("$")))


def not_ignored(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items(id, ...) without those that the rules ignore.

    A file and each folder above it is held against the rules of the folders above that; the last rule that fits
    decides, deeper ignore files after shallower ones. An ignored folder takes all below it along, whatever
    rules say of that. Items meet rules by equal folder names, so a rule is tried where it can hold and nowhere else.
    """
    parts = F.split("id", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = items.select("id").distinct().select("id", F.posexplode(heads).alias("at", "step"), (F.size(parts) - 1).alias("last"))
    above = F.transform(F.sequence(F.lit(0), F.col("at")), lambda n: F.array_join(F.slice(F.split("step", "/"), 1, n), "/"))
    tried = steps.select("id", "at", "step", (F.col("at") < F.col("last")).alias("is_folder"), F.explode(above).alias("folder")).join(rules, "folder")
    fits = tried.where((F.col("is_folder") | ~F.col("only_folders")) & F.regexp("step", F.col("pattern")))
    decided = fits.groupBy("id", "at").agg(F.max_by("keep", F.struct(F.length("folder"), F.col("file") == ".ignore", "ord")).alias("keep"))
    return items.join(decided.where("not keep").select("id").distinct(), "id", "left_anti")


def code_files(spark: SparkSession, root: str, languages: list[str] | None = None, excludes: tuple[str, ...] = EXCLUDES, only: DataFrame | None = None) -> DataFrame:
    """Source files of the given languages (all known ones by default) that no ignore file names, with their language."""
    alias = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "rb": "ruby"}
    wanted = [alias.get(x.strip().lower(), x.strip().lower()) for x in languages or []] or ["rust", "typescript", "python", "ruby"]
    found = scan(spark, root, excludes, only, CODE).withColumn("language", language(F.col("id"))).where(F.col("language").isin(wanted))
    return not_ignored(found, ignore_rules(spark, root, excludes))


def notes(spark: SparkSession, root: str, excludes: tuple[str, ...] = EXCLUDES, only: DataFrame | None = None) -> DataFrame:
    """Markdown notes with their raw text."""
    return scan(spark, root, excludes, only, r"(?i)\.md$").where(extension(F.col("id")) == "md").withColumn("raw", F.decode("content", "UTF-8"))


def only(items: DataFrame, paths: DataFrame) -> DataFrame:
    """The work items of an explicit list of ids."""
    return items.join(paths.select("id").distinct(), "id", "left_semi")
