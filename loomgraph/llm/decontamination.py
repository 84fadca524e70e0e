"""Operator 9, benchmark decontamination by SimHash windows.

A document is contaminated by an item when a window of the item's own number of words is similar to
it: weighted Jaccard similarity of the five-word shingles 0.8 or more. A document with fewer words than
the item is one window as a whole, verified against every such item without fingerprints. A shingle of the benchmark
weighs one over the number of items that have it, any other weighs 1. Windows start at every word.
A window whose benchmark shingles weigh too little to reach the similarity with any item is passed
over (an exact upper bound). The others get a 64-bit SimHash of their words, looked up in a
multi-index: the bits are cut into RADIUS + 1 blocks, so every item fingerprint within the radius
agrees in at least one block; candidates within the radius are then verified by their shingles.

The benchmark goes to the tasks in blocks of at most ITEMS_A_BLOCK items, one narrow pass over the
documents each, so no document is shuffled. Owners are counted over the whole benchmark; each block gets
the weights of all shingles with several owners (others weigh 1), so blocks don't change decisions.

Cases: null, empty and blank texts hit nothing, nor do items without words; an item under five words
is one shingle and matches as a whole; repeated items are one item; repeated documents are judged
alike; an empty table or benchmark leaves no hits; further columns pass through, except that a column
named bench_items or bench_similarity is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import U64, mix, table, utf8, word_hashes

SHINGLE, SIMILARITY, RADIUS, ITEMS_A_BLOCK = 5, 0.8, 12, 20_000
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    out = np.zeros(len(words) - n + 1, dtype=U64)
    for k in range(n):
        out += mix(words[k : len(words) - n + 1 + k] + U64(k)) * _STEP[k]
    return mix(out)


def bits(words: np.ndarray) -> np.ndarray:
    """One row of 64 values +1 or -1 for each word."""
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 sums to 64-bit fingerprints."""
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).copy().view(U64).ravel()


class Index:
    """Items by length, with shingles, weights and the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], owners: dict[int, int], radius: int = RADIUS, similarity: float = SIMILARITY):
        """owners: number of items of the whole benchmark that have a shingle, where there are several."""
        self.radius, self.similarity = radius, similarity
        self.items = []
        known = set(owners)
        for item, text in sorted(items):
            words, _ = word_hashes(*utf8(pa.array([text])))
            if len(words):
                own = np.unique(grams(words, min(SHINGLE, len(words))))
                self.items.append((item, len(words), own))
                known.update(own.tolist())
        self.shingles = np.array(sorted(known), dtype=U64)
        self.weights = np.array([1 / owners.get(s, 1) for s in self.shingles.tolist()])
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.shingles & U64((1 << 22) - 1)] = True
        self.lengths: dict[int, list[int]] = defaultdict(list)
        self.blocks: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.cuts = [(U64(lo), U64((1 << int(hi - lo)) - 1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        self.prints = np.zeros(len(self.items), dtype=U64)
        text_of = dict(items)
        for i, (item, n, _) in enumerate(self.items):
            words, _ = word_hashes(*utf8(pa.array([text_of[item]])))
            self.prints[i] = fingerprint(bits(words).sum(axis=0)[None, :])[0]
            self.lengths[n].append(i)
            for b, (shift, mask) in enumerate(self.cuts):
                self.blocks[n, b, int((self.prints[i] >> shift) & mask)].append(i)
        #: Least weight of an item of each length, and the items of each shingle: sorted shingles beside item numbers.
        self.longest = max(self.lengths, default=0)
        self.least = {n: min(float(self.weigh(self.items[i][2])[1].sum()) for i in members) for n, members in self.lengths.items()}
        every = np.concatenate([np.zeros(0, dtype=U64), *(own for _, _, own in self.items)])
        order = np.argsort(every, kind="stable")
        self.posted, self.owner = every[order], np.repeat(np.arange(len(self.items)), [len(own) for _, _, own in self.items])[order]

    def sharing(self, shingles: np.ndarray) -> list[int]:
        """Items that have one of the shingles."""
        own = np.unique(shingles)
        lo, hi = np.searchsorted(self.posted, own, "left"), np.searchsorted(self.posted, own, "right")
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(self.owner[a:b] for a, b in zip(lo, hi, strict=True) if a < b)])).tolist()

    def weigh(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is a shingle of the block or of several items, and its weight."""
        known = self.seen[shingles & U64((1 << 22) - 1)]
        at = np.flatnonzero(known)
        weight = np.ones(len(shingles))
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, shingles[at]), len(self.shingles) - 1)
            hit = self.shingles[place] == shingles[at]
            known[at[~hit]] = False
            weight[at[hit]] = self.weights[place[hit]]
        return known, weight

    def verify(self, i: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item's shingles and a window's."""
        own, theirs = self.items[i][2], np.unique(window)
        both, all_ = np.intersect1d(own, theirs), np.union1d(own, theirs)
        return float(self.weigh(both)[1].sum() / self.weigh(all_)[1].sum())

    def search(self, words: np.ndarray, known: np.ndarray, weight: np.ndarray, shingles: np.ndarray) -> dict[int, float]:
        """Items in one document, with the similarity of their best window."""
        found: dict[int, float] = {}
        sums = None
        known_sum = np.concatenate([[0.0], np.cumsum(np.where(known, weight, 0.0))])
        rest_sum = np.concatenate([[0], np.cumsum(~known)])
        if len(words) < self.longest:  # of longer items the whole document is the window; those that share nothing have no similarity
            for i in self.sharing(shingles[known]):
                item, n, _ = self.items[i]
                sim = self.verify(i, shingles) if n > len(words) and n >= SHINGLE else 0.0
                if sim >= self.similarity:
                    found[item] = max(sim, found.get(item, 0.0))
        for n in self.lengths:
            if n < SHINGLE or n > len(words):
                continue
            k, starts = n - SHINGLE + 1, np.arange(len(words) - n + 1)
            # repeats in a window make its set smaller, so unknown shingles count once at most in the bound
            have, rest = known_sum[starts + k] - known_sum[starts], rest_sum[starts + k] - rest_sum[starts]
            near = np.flatnonzero((have >= self.similarity * self.least[n] - 1e-9) & (have > 0) & (rest < k))
            if not len(near):
                continue
            if sums is None:
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits(words), axis=0, dtype=np.int32)])
            for at in range(0, len(near), 4096):
                part = near[at : at + 4096]
                prints = fingerprint(sums[part + n] - sums[part])
                for b, (shift, mask) in enumerate(self.cuts):
                    for s, p, v in zip(part.tolist(), prints.tolist(), ((prints >> shift) & mask).tolist(), strict=True):
                        for i in self.blocks.get((n, b, v), ()):
                            if (int(self.prints[i]) ^ p).bit_count() <= self.radius and found.get(self.items[i][0], 0.0) < 1.0:
                                sim = self.verify(i, shingles[s : s + k])
                                if sim >= self.similarity:
                                    found[self.items[i][0]] = max(sim, found.get(self.items[i][0], 0.0))
        return found


def _scan(index: Index, schema: pa.Schema | None = None):
    short = sorted(n for n in index.lengths if n < SHINGLE)
    least_long = min((n for n in index.lengths if n >= SHINGLE), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(*utf8(batch.column("text")))
            shingles = grams(words, SHINGLE)
            known, weight = index.weigh(shingles)
            hits = np.concatenate([[0], np.cumsum(known)])
            items, best = batch.column("bench_items").to_pylist(), batch.column("bench_similarity").to_pylist()
            for r in range(batch.num_rows):
                lo, hi = int(first[r]), int(first[r + 1])
                found: dict[int, float] = {}
                last = hi - SHINGLE + 1  # shingles that stay within the document
                if least_long and last > lo and hits[last] - hits[lo]:
                    found = index.search(words[lo:hi], known[lo:last], weight[lo:last], shingles[lo:last])
                for n in short:
                    own = set(grams(words[lo:hi], n).tolist())
                    found |= {index.items[i][0]: 1.0 for i in index.lengths[n] if int(index.items[i][2][0]) in own}
                if found:
                    items[r], best[r] = sorted({*items[r], *found}), max(best[r], *found.values())
            at = [batch.schema.get_field_index(c) for c in ("bench_items", "bench_similarity")]
            columns = list(batch.columns)
            columns[at[0]], columns[at[1]] = pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())
            yield pa.record_batch(columns, names=batch.schema.names)

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> shingle: the distinct shingles of each item."""
    for batch in batches:
        words, first = word_hashes(*utf8(batch.column("text")))
        own = [np.unique(grams(words[lo:hi], min(SHINGLE, hi - lo))) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if hi > lo]
        yield pa.record_batch({"shingle": pa.array(np.concatenate([np.zeros(0, U64), *own]).view(np.int64))})


def search_benchmark(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """docs(text, ...) -> docs with bench_items (array of item_id, sorted) and bench_similarity (of the best window, 0 for none)."""
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    blocks = -(-items.count() // (items_a_block // 2)) or 1  # half full on the whole, so that none is over
    out = docs.drop("bench_items", "bench_similarity").withColumns({"bench_items": F.array().cast("array<long>"), "bench_similarity": F.lit(0.0)})
    several = items.select("text").mapInArrow(_item_shingles, "shingle long").groupBy("shingle").count().where("count > 1").collect()
    owners = {r.shingle % 2**64: r["count"] for r in several}
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        index = Index([(r.item_id, r.text) for r in part], owners, radius, similarity)
        if index.items:
            out = out.mapInArrow(_scan(index), out.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("bench_items") > 0).alias("contaminated"), F.size("bench_items").cast("long").alias("n_items"),
        F.array_join(F.col("bench_items").cast("array<string>"), ",").alias("items"), F.round("bench_similarity", 6).alias("similarity"),
    )
