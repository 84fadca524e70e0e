"""Filter interaction audit: what five filters keep and lose, in each of the 120 orders, by part of the corpus.

A document's failures are a mask of five bits. Every mask is one big integer of 64-bit fields that holds
the outcome of all 600 steps (120 orders, 5 steps each): kept, removed here, failing but removed earlier.
The integers are summed by part, once over all documents, once over the good and once over the toxic
ones, and then cut into fields again. A field is at most the number of rows, which Spark counts in 63
bits, so no field runs over into the next one.

Documents with equal text have the same mask but for the copy filter, so rows are counted by text, part
and labels before anything is compared: a text that a third of all rows hold is some rows a task. The
window over a text sees at most four rows of each part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import table, utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
COPY = 1 << FILTERS.index("E")
#: Thresholds of the filters: words at least, percent of words distinct at least, percent of capitals at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
FIELD = 64

_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_INSIDE = bytes(range(0x80, 0xC0))
SIGNS = (b"#", b"$", b"%", b"&", b"*", b"|")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20


def packed(mask: int) -> int:
    """The integer of a mask: fields kept, removed and redundant of each step, then one for each filter that fails alone."""
    fails, out = {f for i, f in enumerate(FILTERS) if mask >> i & 1}, 0
    for at, (order, k) in enumerate(STEPS):
        earlier, now = fails & set(order[:k]), order[k] in fails
        kind = 0 if not earlier and not now else 1 if not earlier else 2 if now else None
        if kind is not None:
            out |= 1 << FIELD * (kind * len(STEPS) + at)
    for i, f in enumerate(FILTERS):
        if fails == {f}:
            out |= 1 << FIELD * (3 * len(STEPS) + i)
    return out


N_FIELDS = 3 * len(STEPS) + len(FILTERS)


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(N_FIELDS * FIELD // 8, "little"), "<u8").astype(np.int64)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails; words are read in blocks, so only distinct ones are held."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _BLANK.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    capitals, points = len(text.translate(None, _NOT_CAPITAL)), len(text.translate(None, _INSIDE))
    failed = (n < LEAST_WORDS, 100 * len(seen) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, any(c in text for c in SIGNS))
    return sum(1 << i for i, f in enumerate(failed) if f)


def masks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, part, key (SHA-256 of the text), mask of the filters A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            keys = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), keys, pa.array([failures(x) for x in texts], pa.int32())], names=["doc_id", "part", "key", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, key binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part, mask of all five filters and labels: part, mask, good, toxic, n.

    Copies are told by the least doc_id of their text over all parts. Repeated rows of that document, and rows
    without a doc_id, are no copies; rows without a doc_id have no labels either.
    """
    cells = masks(docs).groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("deal", F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(0))  # rows without an id don't meet in one task
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic")).withColumn("deal", F.lit(0))
    marked = cells.join(marks, ["doc_id", "deal"], "left").withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = marked.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"))
    least = F.min("first.doc_id").over(W.partitionBy("key"))
    originals = F.col("without") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    texts = texts.withColumn("originals", originals)
    split = F.array(F.struct(F.col("mask"), F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    rows = texts.select("part", "good", "toxic", F.explode(split).alias("c")).where("c.n > 0")
    return rows.groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps(counts: DataFrame) -> DataFrame:
    """mask_counts -> a row for each part, order and step; a part is at most 128 rows of counts."""

    def run(table_: pa.Table) -> pa.Table:
        whole = {m: packed(m) for m in set(table_["mask"].to_pylist())}
        every = good = toxic = 0
        for r in table_.to_pylist():
            sum_ = whole[r["mask"]] * r["n"]
            every, good, toxic = every + sum_, good + sum_ * r["good"], toxic + sum_ * r["toxic"]
        n, s = len(STEPS), unpacked(every)
        filter_ = np.array([FILTERS.index(order[k]) for order, k in STEPS])
        removed = s[n : 2 * n]
        return pa.table({
            "part": [table_["part"][0].as_py()] * n, "filter_order": [order for order, _ in STEPS], "step": pa.array([k + 1 for _, k in STEPS], pa.int32()),
            "kept": s[:n], "removed": removed, "redundant": s[2 * n : 3 * n], "unique_fails": s[3 * n :][filter_],
            "good_lost": unpacked(good)[n : 2 * n], "toxic_lost": unpacked(toxic)[n : 2 * n],
            "shapley": np.array([removed[filter_ == f].sum() for f in range(len(FILTERS))])[filter_],
        })

    return counts.groupBy("part").applyInArrow(run, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, source, text), labels(doc_id, quality, toxic) -> 600 rows for each part.

    A null text is empty and a null source the part ''. A document is good (toxic) if any of its labels says 1;
    other columns are not looked at. No documents give no rows. Texts of any length are read whole.
    """
    return steps(mask_counts(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
with recursive l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') part, coalesce("text", '') txt from documents),
w as (select doc_id, part, txt, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') words from d),
f as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    case when len(words) < 50 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 5 * length(txt) then 'C' else '' end || case when regexp_matches(txt, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by txt) then 'E' else '' end fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from f group by part, fails),
o(filter_order) as (select '' union all select filter_order || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) x) where not contains(filter_order, x)),
s as (select filter_order, k step, filter_order[k] own, filter_order[:k - 1] before from o, (select unnest(range(1, 6)) k) where length(filter_order) = 5),
x as (
  select part, filter_order, step, own, n, good, toxic, contains(fails, own) now, fails = own alone,
    before <> '' and fails <> '' and list_has_any(string_split(before, ''), string_split(fails, '')) earlier
  from c, s),
r as (
  select part, filter_order, step, own, sum(case when not earlier and not now then n else 0 end) kept, sum(case when not earlier and now then n else 0 end) removed,
    sum(case when earlier and now then n else 0 end) redundant, sum(case when alone then n else 0 end) unique_fails,
    sum(case when not earlier and now then good else 0 end) good_lost, sum(case when not earlier and now then toxic else 0 end) toxic_lost
  from x group by part, filter_order, step, own)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) shapley
from r
"""
