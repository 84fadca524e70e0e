"""A sink of one text file for each row: notes written back into a vault."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class NoteFiles(DataSource):
    """Format `note_files`, written only: rows (path, text), option root. A row replaces the file at its path.

    Tasks write beside the places under names of their own; the files are moved where they belong once all tasks
    are done, so that a failed job leaves the vault as it was.
    """

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["root"])


@dataclass
class _Moves(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> _Moves:
        system, root = fs.FileSystem.from_uri(self.root)
        moves = []
        for row in iterator:
            folder, _, name = f"{root.rstrip('/')}/{row.path}".rpartition("/")
            system.create_dir(folder, recursive=True)
            beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(beside) as f:
                f.write(row.text.encode())
            moves.append((beside, f"{folder}/{name}"))
        return _Moves(moves)

    def commit(self, messages: list[_Moves | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for a, b in m.moves if m else ():
                system.move(a, b)

    def abort(self, messages: list[_Moves | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for a, _ in m.moves if m else ():
                system.delete_file(a)


def write_notes(notes: DataFrame, root: str) -> None:
    """notes(path, text) as files below root; of equal paths the largest text is written, climbing paths are an error."""
    notes.sparkSession.dataSource.register(NoteFiles)
    once = notes.groupBy("path").agg(F.max("text").alias("text"))
    if once.where(F.col("path").isNull() | (F.col("path") == "") | F.startswith("path", F.lit("/")) | F.concat(F.lit("/"), "path", F.lit("/")).contains("/../")).limit(1).count():
        raise ValueError("a note's path must lie below its vault")
    once.write.format("note_files").option("root", root.rstrip("/")).mode("append").save()
