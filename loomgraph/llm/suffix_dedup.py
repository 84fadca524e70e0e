"""Operator 4, suffix-array dedup: prefix doubling over sampled positions.

Removes each byte that a LENGTH-byte string covers which also starts anywhere else. A table of every
byte position doesn't fit the limits (8 bytes of rank and 8 of position are 16 times the input), so
positions are sampled by content first, and single positions are ranked only where a repeat is left:

1. Every window of LENGTH bytes names an anchor: the position in it whose GRAM-byte string has the
   least hash, the first such. Equal windows name the same anchor at the same offset. A run is a
   stretch of windows with one anchor, about a hundred bytes. Rank of a run: the hash of its anchor's
   GRAM bytes. Runs are sorted by rank and those with a unique rank are done.
2. The offset grows: the rank is paired with that of the run's whole span, all its windows, up to two
   windows long. Where the pair repeats, all windows of the run are repeated; one run of each such
   pair stays in the race, as other runs may share some of its windows.
3. Runs left, whose anchor has several spans, are opened to single positions: their windows are ranked
   at the threshold, LENGTH bytes, and those whose rank is unique are done; the others are repeats.

Ranks are 64-bit fingerprints of the strings themselves (naming instead of numbering, so the rank of a
pair needs no second sort); strings are compared at LENGTH bytes only among equal anchors. Anchors with
up to HOT spans are compared in one task each, several at once; the rest, however many, position by
position in a counted join, which Spark splits. Texts are told apart by a 128-bit hash: equal texts are
opened once.

Cases: null and empty texts have 0 bytes and the hash of nothing; texts under LENGTH bytes keep
everything; repeated rows are separate documents, so their texts repeat each other; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import U64, prefix_sums, range_hash, sliced, table, utf8, written

LENGTH, GRAM, HOT = 200, 40, 5_000
#: A text is sampled in pieces, so that places fit the low bits of a hash.
PIECE, PLACE_BITS = 1 << 18, 20


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor, anchor rank and span rank of each run of a text."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for lo in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[lo : lo + PIECE + length - 1]
        sums = prefix_sums(piece)
        at = np.arange(len(piece) - gram + 1)
        h = range_hash(sums, at, at + gram)
        low = (h >> U64(PLACE_BITS) << U64(PLACE_BITS)) | at.astype(U64)
        width, step = length - gram + 1, 1  # least of `width` neighbours by doubling
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < width:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        anchor = (low & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(begin[1:], len(anchor)) - 1
        a = anchor[begin]
        out[0].append(begin + lo)
        out[1].append(end + lo)
        out[2].append(a + lo)
        out[3].append(h[a])
        out[4].append(range_hash(sums, begin, end + length) * U64(0x9E3779B97F4A7C15) + (a - begin).astype(U64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64 if i < 3 else U64) for i, x in enumerate(out))


def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sampled(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts(key, text) -> a row for each run: key, s, e (window starts), rank, span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, at = utf8(batch.column("text"))
            found = [runs(data[a:b], length, gram) for a, b in zip(at[:-1], at[1:], strict=True)]
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            s, e, _, rank, span = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(5))
            yield pa.record_batch({"key": batch.column("key").take(pa.array(doc)), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "rank": pa.array(rank.view(np.int64)), "span": pa.array(span.view(np.int64))})

    return texts.mapInArrow(run, "key binary, s int, e int, rank long, span long")


def _windows(blob: bytes, n: int, length: int) -> np.ndarray:
    sums = prefix_sums(np.frombuffer(blob, np.uint8))
    at = np.arange(n)
    return range_hash(sums, at, at + length)


def _opened(length: int):
    """Texts with the runs to open -> (rank, offset of the anchor's first window, key, s, times, the span's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, at = utf8(batch.column("text"))
            rows = batch.column("open").to_pylist()
            doc, flat = [], []
            for i, own in enumerate(rows):
                flat += own
                doc += [i] * len(own)
            blobs = [data[at[i] + r["s"] : at[i] + r["e"] + length].tobytes() for i, r in zip(doc, flat, strict=True)]
            yield pa.record_batch({
                "rank": pa.array([r["rank"] for r in flat], pa.int64()), "key": batch.column("key").take(pa.array(doc, pa.int64())), "s": pa.array([r["s"] for r in flat], pa.int32()),
                "n": pa.array([r["e"] - r["s"] + 1 for r in flat], pa.int32()), "times": pa.array([r["times"] for r in flat], pa.int64()), "hot": pa.array([r["hot"] for r in flat], pa.bool_()), "bytes": pa.array(blobs, pa.binary()),
            })

    return run


OPENED = "rank long, key binary, s int, n int, times long, hot boolean, bytes binary"


def _intervals(at: np.ndarray, length: int) -> list[dict]:
    """Sorted window starts to merged byte ranges."""
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [{"a": int(p[0]), "b": int(p[-1]) + length} for p in np.split(at, cut)] if len(at) else []


def _compare(length: int):
    """Opened runs, all of one rank together -> key, ranges: bytes of repeated windows."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        blobs, n, s, times = t["bytes"].to_pylist(), t["n"].to_numpy(), t["s"].to_numpy(), t["times"].to_numpy()
        h = np.concatenate([_windows(b, k, length) for b, k in zip(blobs, n.tolist(), strict=True)])
        row = np.repeat(np.arange(len(n)), n)
        _, back, seen = np.unique(h, return_inverse=True, return_counts=True)
        repeated = (seen[back] > 1) & (times[row] == 1)  # a span that repeats whole is known already
        first = np.cumsum(n) - n
        place = np.arange(len(h)) - first[row] + s[row]
        hit = np.flatnonzero(repeated)
        cuts = np.flatnonzero(np.diff(row[hit])) + 1
        parts = np.split(hit, cuts) if len(hit) else []
        return pa.record_batch({"key": t["key"].combine_chunks().take(pa.array([row[p[0]] for p in parts], pa.int64())), "ranges": pa.array([_intervals(place[p], length) for p in parts], RANGES)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by rank: cut where the rank changes
            rank = batch.column("rank").to_numpy()
            if held and size > 20_000:
                same = rank == held[-1].column("rank")[-1].as_py()
                k = int(np.argmin(same)) if not same.all() else len(rank)
                held.append(batch.slice(0, k))
                if k == len(rank):
                    continue
                yield flush(held)
                held, size, batch = [], 0, batch.slice(k)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield flush(held)

    return run


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _positions(length: int):
    """Opened runs of hot ranks -> one row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            h = [_windows(b.as_py(), k, length) for b, k in zip(batch.column("bytes"), n.tolist(), strict=True)]
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row] + batch.column("s").to_numpy()[row]
            yield pa.record_batch({"key": batch.column("key").take(pa.array(row)), "at": pa.array(place.astype(np.int32)), "h": pa.array((np.concatenate(h) if h else np.zeros(0, U64)).view(np.int64)), "times": batch.column("times").take(pa.array(row))})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with ranges -> key, n_removed, n_spans, kept_sha256, spans."""
    for batch in sliced(batches):
        data, at = utf8(batch.column("text"))
        removed, spans, shas = [], [], []
        for i, own in enumerate(batch.column("ranges").to_pylist()):
            text = data[at[i] : at[i + 1]]
            mark = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(mark, [r["a"] for r in own], 1)
            np.add.at(mark, [r["b"] for r in own], -1)
            gone = np.cumsum(mark)[:-1] > 0
            removed.append(int(gone.sum()))
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            spans.append([{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            shas.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        yield pa.record_batch({"key": batch.column("key"), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, RANGES), "kept_sha256": pa.array(shas, pa.string())})


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> rows(doc_id, key, n_bytes, sha) and, for texts with repeats, cut(key, n_removed, spans, kept_sha256)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    texts = docs.where(F.octet_length("text") >= length).select(text_key(F.col("text")).alias("key"), "text")
    r = written(sampled(texts, length, gram), "runs")
    # first rank: anchors that stand once are done
    ranks = r.groupBy("rank").agg(F.count(F.lit(1)).alias("c"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("c > 1")
    kept = written(r.join(ranks.select("rank", (F.col("lo") != F.col("hi")).alias("mixed")), "rank"), "repeated")
    # second rank: whole spans; every run of an unmixed anchor repeats as a whole
    whole = kept.where("not mixed").select("key", "s", "e")
    mixed = kept.where("mixed")
    pairs = mixed.groupBy("rank", "span").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "s", "e")).alias("one"))
    again = mixed.join(pairs.where("times > 1").select("rank", "span"), ["rank", "span"], "left_semi").select("key", "s", "e")
    per_rank = pairs.groupBy("rank").agg(F.count(F.lit(1)).alias("spans"))
    to_open = pairs.join(per_rank, "rank").select("one.key", F.struct(F.col("one.s").alias("s"), F.col("one.e").alias("e"), "rank", "times", (F.col("spans") > hot).alias("hot")).alias("o"))
    by_text = to_open.groupBy("key").agg(F.collect_list("o").alias("open"))  # at most a text's own runs
    # texts that have a repeated anchor, once each
    named = kept.select("key").distinct()
    some = written(texts.join(named, "key", "left_semi").dropDuplicates(["key"]), "texts")
    opened = written(some.join(by_text, "key").mapInArrow(_opened(length), OPENED), "opened")
    cold = opened.where("not hot").select("rank", "key", "s", "n", "times", "bytes").repartition("rank").sortWithinPartitions("rank")
    ranges = cold.mapInArrow(_compare(length), "key binary, ranges array<struct<a:int,b:int>>").select("key", F.explode("ranges").alias("x")).select("key", "x.a", "x.b")
    single = opened.where("hot").mapInArrow(_positions(length), "key binary, at int, h long, times long")
    twice = single.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    hot_ranges = single.where("times = 1").join(twice, "h", "left_semi").select("key", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    full = whole.union(again).distinct().select("key", F.col("s").alias("a"), (F.col("e") + length).alias("b"))
    found = full.union(ranges).union(hot_ranges)
    by_key = found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))  # within one text
    cut = some.join(by_key, "key").mapInArrow(_cut, "key binary, n_removed long, spans array<struct<a:int,b:int>>, kept_sha256 string")
    return rows, cut


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = repeats(table(spark, sf_dir, "documents"))
    short = cut.select("key", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    j = rows.join(short, "key", "left")
    return j.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
