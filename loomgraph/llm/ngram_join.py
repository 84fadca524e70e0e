"""Operator 1, n-gram Jaccard join with a token-group matrix.

A document's set is its distinct 3-word shingles, lower-cased; two documents link when their sets'
Jaccard similarity is at least 0.9. No link is lost:

1. Equal sets are one class, known by a hash of the set; copies cost one row each from here on.
2. Grouping. Sets of similar size share a scheme that cuts the token space into parts, more of them than
   two linked sets can differ in, so linked sets agree in several whole parts. A class gives a signature
   for each part, except for weak parts (few tokens, or none but common ones): as long as fewer parts are
   weak than must agree, one agreeing part is not weak, so nothing is lost by leaving them out; a set with
   more weak parts gives all. Classes that share a signature fall into one group (connected
   components). Sets that share common passages only don't agree in parts, so groups hold near copies.
   Which tokens are common is known from a sketch of bounded size over every token of every document.
3. Groups above BLOCK classes are cut into blocks by size and hash; each pair of blocks whose sizes can
   link is one task. A task stores the token union of each small group of alike sets as a row of the
   token-group matrix, bounds by one product what every set can have in common with any member of a
   group, and opens only groups that qualify; their members are verified exactly.
4. A task returns links as a spanning forest and counts, never as pairs; components follow from those.

Signatures travel packed: a task sends those of one bucket of hash values as one row of two arrays.

Tokens and sets are told apart by 64-bit hashes, signatures too; sets with equal hashes count as equal.

Cases: null, empty and blank texts have 0 shingles, are components of their own and link to nothing,
themselves included; a text of one or two words is one shingle; repeated rows are documents with equal
sets; rows that share a doc_id share its component; an empty table gives no rows; the texts of any
length are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import U64, components, least_reached, mix, sliced, table, utf8, word_hashes, written

SHINGLE, PERCENT, BLOCK, SUBGROUP = 3, 90, 256, 16
#: Most tokens of a block.
BLOCK_TOKENS = 2_000_000
#: Sizes of a scheme reach from its least to RATIO times that; it has SPARE times the parts that two linked sets can differ in.
RATIO, SPARE = 1.4, 1.25
#: The sketch of common tokens: buckets of hash values; a bucket is common from COMMON times the mean on.
SKETCH_BITS, COMMON = 20, 16
#: Signatures that a task packs at once, and those of a bucket.
PACKED, BUCKET = 1_000_000, 500_000
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(*utf8(column))
    spread = [mix(words + U64(k)) * _STEP[k] for k in range(size)]
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        k = min(size, hi - lo)
        if not k:
            out.append(words[:0])
            continue
        own = spread[0][lo : hi - k + 1].copy()
        for j in range(1, k):
            own += spread[j][lo + j : hi - k + 1 + j]
        out.append(np.unique(mix(own)))
    return out


class Schemes:
    """Least sizes of the schemes, and the edges of their parts, for a similarity in percent."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.share = percent / 100
        self.common = common
        self.least_size = next(n for n in range(1, 10**6) if 100 * n >= percent * (n + 1))  # I / (I + 1) reaches the similarity
        self.least = [self.least_size]
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def of(self, n: int) -> list[int]:
        """The schemes of a set of n shingles: its own, and the next if a linked set can be in it."""
        while self.least[-1] <= n / self.share + 1:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * RATIO)))
        if n < self.least_size:
            return [0] if n + 1 >= self.least_size and n >= self.share * self.least_size else []
        own = int(np.searchsorted(self.least, n, side="right")) - 1
        return [own, own + 1] if n >= self.share * self.least[own + 1] - 1e-9 else [own]

    def edges(self, scheme: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Edges and names of a scheme's parts, and the most tokens that two linked sets in it can differ in."""
        if scheme not in self.parts:
            while len(self.least) < scheme + 2:
                self.least.append(max(self.least[-1] + 1, int(self.least[-1] * RATIO)))
            most = self.least[scheme + 1] - 1
            differ = int((1 - self.share) / (1 + self.share) * 2 * most + 1e-9)
            k = int(differ * SPARE) + 2
            cuts = np.array([i * 2**64 // k for i in range(1, k)], dtype=U64)
            self.parts[scheme] = cuts, mix(np.arange(k, dtype=U64) + U64((scheme + 1) << 32)), differ
        return self.parts[scheme]

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """Hashes of the parts of each scheme of a set, weak ones left out where that loses nothing."""
        out = [own[:0]]
        schemes = self.of(len(own))
        if schemes:
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(own ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64)])
            telling = np.ones(len(own), np.int64) if self.common is None else 1 - self.common[own >> U64(64 - SKETCH_BITS)]
            told = np.concatenate([[0], np.cumsum(telling)])
            most = int((1 - self.share) / self.share * len(own) + 1e-9)  # tokens that a linked set can differ in
            for s in schemes:
                cuts, names, differ = self.edges(s)
                at = np.concatenate([[0], np.searchsorted(own, cuts), [len(own)]])
                sigs = mix((sums[at[1:]] - sums[at[:-1]]) * U64(0x9E3779B97F4A7C15) + np.diff(at).astype(U64) + names)
                strength, agree = told[at[1:]] - told[at[:-1]], len(names) - min(differ, most)
                for least in (4, 3, 2, 1):
                    strong = strength >= least
                    if len(sigs) - int(strong.sum()) < agree:
                        sigs = sigs[strong]
                        break
                out.append(sigs)
        return np.concatenate(out)


def class_hash(own: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    if not len(own):
        return 0
    h = mix(np.array([np.bitwise_xor.reduce(mix(own + U64(1)))], U64) * U64(3) + np.sum(mix(own ^ U64(0x5bd1e995)), dtype=U64) + U64(len(own)))
    return int(h.view(np.int64)[0])


FREQUENT = pa.list_(pa.struct([("b", pa.int64()), ("c", pa.int64())]))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, cid, and rows with n = -1 with a task's frequent buckets of tokens (bucket, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        kind = None
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), size)
            cids = [class_hash(s) for s in sets]
            apart = list(dict(zip(cids, sets, strict=True)).values())
            if apart:
                counts += np.bincount((np.concatenate(apart) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            kind = batch.column("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cids, pa.int64()), pa.nulls(len(sets), FREQUENT)], names=["doc_id", "n", "cid", "frequent"])
        if kind is not None:
            hot = np.flatnonzero(counts >= max(4, COMMON * counts.sum() / len(counts)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([[{"b": b, "c": c} for b, c in zip(hot.tolist(), counts[hot].tolist(), strict=True)]], FREQUENT)], names=["doc_id", "n", "cid", "frequent"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, cid long, frequent array<struct<b:long,c:long>>")


def common_tokens(p: DataFrame) -> np.ndarray:
    """1 for each bucket of tokens that is common in the whole; a bucket is common in the whole only if it is in some task.

    The result only tells which parts are weak, so it has no influence on the links that are found.
    """
    each = p.where("n = -1").select("cid", "frequent")
    total = each.agg(F.sum("cid")).first()[0] or 0
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    sums = each.select(F.explode("frequent").alias("x")).groupBy("x.b").agg(F.sum("x.c").alias("c"))
    # at most 2^SKETCH_BITS / COMMON buckets can pass
    for r in sums.where(F.col("c") >= max(4, COMMON * total / len(out))).select("b").toLocalIterator():
        out[r[0]] = 1
    return out


def signature_rows(docs: DataFrame, size: int, percent: int, common: np.ndarray, buckets: int) -> DataFrame:
    """docs(text) -> bucket, sigs, who, cids: packed signatures; who counts in cids. Rows without sigs hold ties between classes."""

    def packed(sigs: list[np.ndarray], cids: list[int]) -> pa.RecordBatch:
        names = np.array(cids, np.int64)
        flat = np.concatenate(sigs)
        who = np.repeat(np.arange(len(names)), [len(x) for x in sigs])
        order = np.lexsort((names[who], flat))
        flat, who = flat[order], who[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        lead = first[np.cumsum(new) - 1] if len(flat) else first
        rest = ~new
        ties = np.unique(np.stack([names[who[rest]], names[who[lead[rest]]]], axis=1), axis=0)  # classes that agree within the task need no more than that
        flat, who = flat[new], who[new]
        where = (((flat >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(where) else np.zeros(1, np.int64)
        rows = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, back = np.unique(who[lo:hi], return_inverse=True)
            rows.append((int(where[lo]), flat[lo:hi].tobytes(), back.astype(np.uint16).tobytes(), names[own].tobytes()))
        for lo in range(0, len(ties), BUCKET):
            rows.append((int(ties[lo, 0] % buckets), b"", b"", ties[lo : lo + BUCKET].tobytes()))
        return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "sigs": pa.array([r[1] for r in rows], pa.binary()), "who": pa.array([r[2] for r in rows], pa.binary()), "cids": pa.array([r[3] for r in rows], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(percent, common)
        sigs: list[np.ndarray] = []
        cids: list[int] = []
        seen: set[int] = set()
        held = 0
        for batch in sliced(batches):
            for own in shingle_sets(batch.column("text"), size):
                cid = class_hash(own)
                if not len(own) or cid in seen:
                    continue
                seen.add(cid)
                sigs.append(schemes.signatures(own))
                cids.append(cid)
                held += len(sigs[-1])
                if held >= PACKED or len(cids) >= 50_000:
                    yield packed(sigs, cids)
                    sigs, cids, seen, held = [], [], set(), 0
        if cids:
            yield packed(sigs, cids)

    return docs.select("text").mapInArrow(run, "bucket int, sigs binary, who binary, cids binary")


def _agreeing(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket's signatures -> (cid, lo): classes that share a signature, tied to the least of them."""
    sigs, cids, ties = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    for s, w, c in zip(pdf["sigs"], pdf["who"], pdf["cids"], strict=True):
        if len(s):
            sigs.append(np.frombuffer(s, U64))
            cids.append(np.frombuffer(c, np.int64)[np.frombuffer(w, np.uint16)])
        else:
            ties.append(np.frombuffer(c, np.int64).reshape(-1, 2))
    sig, cid = np.concatenate(sigs), np.concatenate(cids)
    order = np.lexsort((cid, sig))
    sig, cid = sig[order], cid[order]
    if len(sig):
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        met = ~new & (cid != cid[lead])
        ties.append(np.stack([cid[met], cid[lead[met]]], axis=1))
    out = np.unique(np.concatenate(ties), axis=0)
    return pd.DataFrame({"cid": out[:, 0], "lo": out[:, 1]})


def token_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs(text) -> cid, tokens (sorted 64-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(batch.column("text"), size)
            yield pa.record_batch({"cid": pa.array([class_hash(s) for s in sets], pa.int64()), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())})

    return docs.select("text").mapInArrow(run, "cid long, tokens binary")


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of links between the sets numbered left and those numbered right, by the token-group matrix.

    Rows of the matrix are unions of SUBGROUP alike sets. Dense pieces of columns bound the memory.
    """
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen[token] > 1  # a token of one set is in no intersection
    number = np.cumsum(seen > 1) - 1
    doc, token = doc[common], number[token[common]]
    width = int((seen > 1).sum())
    least = np.full(len(sets), width, dtype=np.int64)
    np.minimum.at(least, doc, token)
    alike = right[np.lexsort((sizes[right], least[right]))]
    groups = [alike[i : i + SUBGROUP] for i in range(0, len(alike), SUBGROUP)]
    group_of = np.full(len(sets), -1)
    for g, members in enumerate(groups):
        group_of[members] = g
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]

    def dense():
        for lo in range(0, width, 8192):
            a, b = np.searchsorted(token, [lo, lo + 8192])
            m = np.zeros((len(sets), min(8192, width - lo)), np.float32)
            m[doc[a:b], token[a:b] - lo] = 1
            yield m

    bound = np.zeros((len(left), len(groups)), np.float32)
    for m in dense():
        unions = np.stack([m[members].max(axis=0) for members in groups])
        bound += m[left] @ unions.T
    opened = 100 * bound >= percent * sizes[left][:, None] - 1e-3
    out = np.zeros((len(left), len(right)), bool)
    if not opened.any():
        return out
    rows, cols = opened.any(axis=1), np.isin(group_of[right], np.flatnonzero(opened.any(axis=0)))
    l, r = left[rows], right[cols]
    both = np.zeros((len(l), len(r)), np.float32)
    for m in dense():
        both += m[l] @ m[r].T
    both = np.rint(both).astype(np.int64)
    linked = (100 * both >= percent * (sizes[l][:, None] + sizes[r][None, :] - both)) & opened[rows][:, group_of[r]]
    out[np.ix_(rows, cols)] = linked
    return out


def _verify(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"], ignore_index=True)
        sets = [np.frombuffer(t, U64) for t in pdf["tokens"]]
        times = pdf["times"].to_numpy()
        own = bool(pdf["own"].iloc[0])
        left = np.arange(len(sets)) if own else np.flatnonzero(pdf["side"] == 0)
        right = np.arange(len(sets)) if own else np.flatnonzero(pdf["side"] == 1)
        count = np.zeros(len(sets), dtype=np.int64)
        root = np.arange(len(sets))
        if len(left) and len(right):
            linked = links_of(sets, left, right, percent)
            if own:
                np.fill_diagonal(linked, False)
                linked |= linked.T
                count += linked @ times
            else:
                count[left] += linked @ times[right]
                count[right] += linked.T @ times[left]
            a, b = np.nonzero(linked)
            root = least_reached(left[a], right[b], len(sets))
        hit = count > 0
        rep = pdf["rep"].to_numpy()
        return pd.DataFrame({"cid": pdf["cid"][hit], "a": rep[hit], "b": rep[root[hit]], "links": count[hit]})

    return run


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, n_links; one row for each row."""
    p = written(profiles(docs, size), "profiles")
    common = common_tokens(p)
    p = p.where("n >= 0").select("doc_id", "n", "cid")
    classes = p.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"))
    tokens_in_all = p.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(tokens_in_all * 2 * (100 - percent) / 100) // BUCKET)
    agreed = signature_rows(docs, size, percent, common, buckets).groupBy("bucket").applyInPandas(_agreeing, "cid long, lo long")
    # a class meets several leaders; it keeps its least, and the others are tied to that one
    met = agreed.groupBy("cid").agg(F.min("lo").alias("least"), F.collect_set("lo").alias("los"))  # as many as a class has parts
    edges = met.select(F.explode(F.concat("los", F.array("cid"))).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    groups = components(edges).select(F.col("node").alias("cid"), F.col("root").alias("grp"))
    m = written(classes.join(groups, "cid"), "members")
    # blocks: one for a small group; else by octave of the size and hash
    total = m.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("tokens"))
    m = m.join(total, "grp").withColumn("band", F.when((F.col("total") <= block) & (F.col("tokens") <= BLOCK_TOKENS), 0).otherwise(F.floor(F.log("n") / F.log(F.lit(1 / (percent / 100)))).cast("int")))
    bands = written(m.groupBy("grp", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")), "bands")
    m = m.join(bands, ["grp", "band"]).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    o = bands.select("grp", F.col("band").alias("band2"), F.col("blocks").alias("blocks2"))
    # a set of band k links to sets of bands k - 1 to k + 1
    near = m.join(o, "grp").where("abs(band - band2) <= 1").withColumn("blk2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    me, other = F.struct("band", "blk"), F.struct(F.col("band2").alias("band"), F.col("blk2").alias("blk"))
    near = near.select("cid", "rep", "times", "grp", F.least(me, other).alias("p"), F.greatest(me, other).alias("q"), (me > other).cast("int").alias("side"), (me == other).alias("own"))
    ids = m.select(F.col("rep").alias("doc_id")).distinct()
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    tokens = token_sets(wanted, size).groupBy("cid").agg(F.first("tokens").alias("tokens"))
    found = near.join(tokens, "cid").groupBy("grp", "p", "q").applyInPandas(_verify(percent), "cid long, a long, b long, links long")
    found = written(found, "links")
    roots = components(found.select("a", "b")).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = written(classes.join(links, "cid", "left").join(roots, "rep", "left").where("times > 1 or links is not null").select(
        "cid", F.coalesce("component", "rep").alias("component"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    out = p.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(known, "cid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
