"""Fill-in-middle: whole texts cut into prefix, middle and suffix and put together in another order.

A text is cut into tokens and, at two tokens that its doc_id names, into three parts. Its output leaves
the task as pieces of a bounded size, keyed by document and position. Repartitioning by document and
sorting within partitions brings the pieces of a document one after another, so that a task streams them
into the digest of the output and never holds a text. The output's stream is parsed for its markers, the
parts found are keyed by their place in the restored text and sorted again where they are, as the
partitioning by document still holds, and streamed into the digest of the restored text.

A document is known by its doc_id and text, so equal rows are streams of equal pieces: each piece is taken
once and the result is returned for each copy. Copies from different input partitions are kept apart, so
that even a third of all rows being one is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import sliced, table, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of documents that are cut, and percent of those that start with the suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of a piece at most, and bytes looked at at once in a long text.
PIECE, BLOCK = 1 << 15, 1 << 22
#: Bytes of pieces in a batch.
BATCH = 1 << 22
#: Order of the parts of each form in the output, and the marker of each part; parts: 0 prefix, 1 middle, 2 suffix.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKERS = {0: PREFIX, 1: MIDDLE, 2: SUFFIX}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _token_starts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which of the bytes lo to hi begin a token: a run of ASCII letters or any other code point."""
    part = data[lo:hi]
    letter = _LETTER[part]
    out = (part & 0xC0) != 0x80
    out[1:] &= ~(letter[1:] & letter[:-1])
    if lo and len(part) and letter[0] and _LETTER[data[lo - 1]]:
        out[0] = False
    return out


def _tokens(data: np.ndarray) -> list[int]:
    """Number of tokens of each block of a text."""
    return [int(np.count_nonzero(_token_starts(data, lo, lo + BLOCK))) for lo in range(0, len(data), BLOCK)]


def _offset(data: np.ndarray, counts: list[int], k: int) -> int:
    """Byte at which token k begins; the end for one more than there are."""
    for i, n in enumerate(counts):
        if k < n:
            return i * BLOCK + int(np.flatnonzero(_token_starts(data, i * BLOCK, (i + 1) * BLOCK))[k])
        k -= n
    return len(data)


def _code_points(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[lo : lo + BLOCK] & 0xC0) != 0x80)) for lo in range(0, len(data), BLOCK))


def choices(doc_id: int | None) -> list[int]:
    """h1 to h4 of a document; one without an id has those of the empty string."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(doc_id: int | None, data: np.ndarray, raw: bytes) -> tuple[int, str, list[tuple[int, int]]]:
    """Number of tokens, form, and the bytes of prefix, middle and suffix (the whole text alone if plain)."""
    counts = _tokens(data)
    n = sum(counts)
    h1, h2, h3, h4 = choices(doc_id)
    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= CUT:
        return n, "plain", [(0, len(data))]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = _offset(data, counts, a), _offset(data, counts, b)
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", [(0, a), (a, b), (b, len(data))]


def _chunks(data: np.ndarray, lo: int, hi: int) -> Iterator[bytes]:
    """The bytes lo to hi in pieces that end with a token, or inside one that is longer than a piece."""
    while lo < hi:
        end = min(hi, lo + PIECE)
        if end < hi:
            begins = np.flatnonzero(_token_starts(data, lo, end + 1)[1:])
            end = lo + 1 + int(begins[-1]) if len(begins) else end
        yield data[lo:end].tobytes()
        lo = end


META = [("doc_id", None), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def pieces(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> key, deal, pos, bytes of the output; what is known of a document goes with its first piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = TaskContext.get().partitionId()
        for batch in batches:
            for part in sliced([batch]):
                yield from _rows_of(part, deal)

    return docs.select("doc_id", "text").mapInArrow(run, f"key binary, deal int, pos long, bytes binary, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long")


def _rows_of(batch: pa.RecordBatch, deal: int) -> Iterator[pa.RecordBatch]:
    data, offsets = utf8(batch.column("text"))
    id_type = batch.schema.field("doc_id").type
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        types = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), id_type, *(t for _, t in META[1:])]
        return pa.record_batch([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["key", "deal", "pos", "bytes", *(name for name, _ in META)])

    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        text = data[offsets[i] : offsets[i + 1]]
        raw = text.tobytes()
        key = hashlib.sha256(f"{doc_id}\0".encode() + raw).digest()[:16]
        n, form, parts = cut(doc_id, text, raw)
        sizes = (None, None) if form == "plain" else tuple(_code_points(text[a:b]) for a, b in parts[:2])
        pos, meta = 0, (doc_id, n, form, *sizes)
        for part in (0,) if form == "plain" else FORMS[form]:
            marker = b"" if form == "plain" else MARKERS[part]
            for chunk in _chunks(text, *parts[part]):
                rows.append((key, deal, pos, marker + chunk, *meta))
                marker, meta = b"", (None,) * len(META)
                pos, held = pos + 1, held + len(chunk)
                if held > BATCH:
                    yield out()
                    rows, held = [], 0
            if marker or not pos and form == "plain":  # an empty part is its marker, an empty text one empty piece
                rows.append((key, deal, pos, marker, *meta))
                pos, meta = pos + 1, (None,) * len(META)
    if rows:
        yield out()


def _streams(batches: Iterator[pa.RecordBatch], at: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of each document, in order, read one by one; the columns `at` tell a document and must be sorted."""
    rows = (r for batch in batches for part in sliced([batch], 256) for r in part.to_pylist())
    return groupby(rows, lambda r: tuple(r[c] for c in at))


def _once(rows: Iterator[dict], at: list[str]) -> Iterator[tuple[dict, int]]:
    """The first of rows that agree in `at`, and how many they are."""
    for _, same in groupby(rows, lambda r: tuple(r[c] for c in at)):
        first = next(same)
        yield first, 1 + sum(1 for _ in same)


def parsed(chunks: Iterator[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of an output's stream: markers are found in the stream itself, wherever its chunks end."""
    if form == "plain":
        for chunk in chunks:
            yield 0, chunk
        return
    order, at, held = FORMS[form], -1, b""
    for chunk in chunks:
        held += chunk
        while at + 1 < len(order):
            found = held.find(MARKERS[order[at + 1]])
            if found < 0:
                break
            if at >= 0:
                yield order[at], held[:found]
            at, held = at + 1, held[found + 3 :]
        keep = 2 if at + 1 < len(order) else 0  # a marker may begin at the end
        if at >= 0 and len(held) > keep:
            yield order[at], held[: len(held) - keep]
            held = held[len(held) - keep :]
    if held:
        yield order[at], held


def sorted_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of each document together and in the order of its output."""
    return pieces(docs).repartition("key", "deal").sortWithinPartitions("key", "deal", "pos")


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes in bytes, as batches of some megabytes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 100
        if size > BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _meta(doc_id: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("doc_id", doc_id), *META[1:]]


def transform(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output: the texts as they are trained on.

    A null text is an empty one; a null doc_id counts as the empty string. Other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for _, rows in _streams(batches, ["key", "deal"]):
            got = list(_once(rows, ["pos"]))
            first, copies = got[0]
            output = b"".join(r["bytes"] for r, _ in got).decode()
            for _ in range(copies):
                yield {c: first[c] for c, _ in META} | {"output": output}, len(output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            schema = pa.schema([*_meta(head.schema.field("doc_id").type), ("output", pa.string())])
            yield from _batches(texts(chain([head], batches)), schema)

    return sorted_pieces(docs).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def assembled(docs: DataFrame) -> DataFrame:
    """A row for each document with the digest of its output (part -1), and the parts parsed from that output in pieces: key, deal, part, pos, bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for (key, deal), rows in _streams(batches, ["key", "deal"]):
            digest, seen = hashlib.sha256(), {}

            def chunks(rows: Iterator[dict] = rows, digest=digest, seen: dict = seen) -> Iterator[bytes]:
                for r, copies in _once(rows, ["pos"]):
                    if not seen:
                        seen.update({c: r[c] for c, _ in META}, copies=copies)
                    digest.update(r["bytes"])
                    yield r["bytes"]

            source = chunks()
            first = next(source)
            for pos, (part, piece) in enumerate(parsed(chain([first], source), seen["form"])):
                yield {"key": key, "deal": deal, "part": part, "pos": pos, "bytes": piece}, len(piece)
            yield {"key": key, "deal": deal, "part": -1, "pos": 0, "output_sha256": digest.hexdigest(), **seen}, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            own = [("key", pa.binary()), ("deal", pa.int32()), ("part", pa.int32()), ("pos", pa.int64()), ("bytes", pa.binary())]
            schema = pa.schema([*own, *_meta(head.schema.field("doc_id").type), ("copies", pa.int64()), ("output_sha256", pa.string())])
            yield from _batches(stream(chain([head], batches)), schema)

    fields = f"key binary, deal int, part int, pos long, bytes binary, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, copies long, output_sha256 string"
    return sorted_pieces(docs).mapInArrow(run, fields)


def digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; cases as in transform().

    The second sort stays in the partitions of the first: nothing is shuffled again. It puts the row of a document
    before its parts, and those in the order of the restored text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for _, rows in _streams(batches, ["key", "deal"]):
            head, digest = next(rows), hashlib.sha256()
            for r in rows:
                digest.update(r["bytes"])
            out = {c: head[c] for c, _ in META} | {"output_sha256": head["output_sha256"], "restored_sha256": digest.hexdigest()}
            for _ in range(head["copies"]):
                yield out, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            schema = pa.schema([*_meta(head.schema.field("doc_id").type), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
            yield from _batches(stream(chain([head], batches)), schema)

    again = assembled(docs).sortWithinPartitions("key", "deal", "part", "pos")
    return again.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select doc_id, coalesce("text", '') txt, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
k as (select doc_id, txt, regexp_extract_all(txt, '[A-Za-z]+|[^A-Za-z]', 0, 's') units,
  ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, len(units) n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) b,
  case when txt = '' or contains(txt, '<P>') or contains(txt, '<S>') or contains(txt, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from k),
p as (select *, array_to_string(units[:a], '') prefix, array_to_string(units[a + 1:b], '') middle, array_to_string(units[b + 1:], '') suffix from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(prefix) end prefix_chars, case when form <> 'plain' then length(middle) end middle_chars,
  sha256(case form when 'plain' then txt when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
  sha256(txt) restored_sha256
from p
"""
