"""Lexical and vector search: substring predicates, budgets, exact nearest neighbours, fusion of channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import graph

#: Weights of the vector, graph and full-text channels.
VECTOR, GRAPH, LEXICAL = 0.6, 0.3, 0.1
LIMIT, DEPTH, NEIGHBORS = 40, 2, 25


def clamp_limit(limit: int | None) -> int:
    return LIMIT if limit is None else max(1, min(LIMIT, limit))


def clamp_depth(depth: int | None) -> int:
    return 1 if depth is None else max(1, min(DEPTH, depth))


def has(needle: str, *columns: str) -> Column:
    """Whether a column holds the needle, without regard to case; nothing holds a blank one."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(False)
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(c), F.lit(needle))
    return out


def allowed(sources: DataFrame, wanted: list[str] | None) -> DataFrame | None:
    """Names of sources that a filter of kinds or names lets through; None without a filter."""
    names = sorted({w.strip().lower() for w in wanted or [] if w and w.strip()})
    return sources.where(F.lower("kind").isin(names) | F.lower("name").isin(names)).select(F.col("name").alias("source")).distinct() if names else None


def first_per_source(hits: DataFrame, order: list[Column], limit: int, source: str = "source") -> DataFrame:
    """At most limit rows of each source; Spark keeps them group by group before the shuffle."""
    return hits.withColumn("nth", F.row_number().over(W.partitionBy(source).orderBy(*order))).where(F.col("nth") <= limit)


def _packed(rows: DataFrame, id_: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows packed where they are into blocks of at most `size`: name, ids, and a matrix of unit vectors as bytes."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                ids = part.column(0)
                yield pa.record_batch({f"{name}_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), f"{name}_v": pa.array([v.tobytes()], pa.binary())})

    return rows.where(F.col(vector).isNotNull()).select(id_, vector).mapInArrow(run, f"{name}_ids array<{kind}>, {name}_v binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256, id_: str = "vec_id", vector: str = "embedding", groups: int | None = None) -> DataFrame:
    """Exact k nearest by cosine distance: (query_id, id, distance, nth). Vectors are of one dimension; null ones are left out.

    Blocks of vectors are dealt to groups, and blocks of queries go to every group: an equi-join on the group
    brings each pair of blocks together in an executor, whatever their numbers, and the plan is the same for any.
    A task keeps the best k of each query for as many queries as fit, so what is sorted at the end is k rows for
    each query and task.
    """
    spark = vectors.sparkSession
    n = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = queries.where(F.col(vector).isNotNull()).groupBy(id_).agg(F.max(vector).alias(vector))
    q = _packed(once, id_, vector, block, "q").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"))
    v = _packed(vectors, id_, vector, block, "v").withColumn("g", F.pmod(F.xxhash64("v_ids"), F.lit(n)).cast("int"))
    kind = vectors.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for names, (ids, d) in best.items():
                at, own = np.repeat(np.arange(len(names)), d.shape[1]), ids.ravel()
                yield pa.record_batch({"query_id": pa.array(np.array(names)[at]), "id": pa.array(own), "distance": pa.array(d.ravel())})
            best.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                names, ids = tuple(batch.column(0)[i].values.to_pylist()), batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                a = np.frombuffer(batch.column(1)[i].as_buffer(), np.float64).reshape(len(names), -1)
                b = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(len(ids), -1)
                d, own = np.round(1 - a @ b.T, 9), np.broadcast_to(ids, (len(names), len(ids)))
                if names in best:
                    own, d = np.hstack([best[names][0], own]), np.hstack([best[names][1], d])
                top = np.lexsort((own, d), axis=1)[:, :k]
                best[names] = np.take_along_axis(own, top, 1), np.take_along_axis(d, top, 1)
            if len(best) * block > 200_000:
                yield from out()
        yield from out()

    pairs = v.join(q, "g").select("q_ids", "q_v", "v_ids", "v_v").mapInArrow(run, f"query_id {kind}, id {kind}, distance double")
    return pairs.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("nth") <= k)


def distance_to_score(d: Column) -> Column:
    return F.least(F.greatest(1 / (1 + F.greatest(d, F.lit(0.0))), F.lit(0.0)), F.lit(1.0))


def merge_channels(vector_hits: DataFrame, lexical_hits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up the channels of each key: vector_hits(keys, score), lexical_hits(keys, n chunks)."""
    v = vector_hits.groupBy(*keys).agg(F.max("score").alias("score"))
    t = lexical_hits.groupBy(*keys).agg(F.sum("n").alias("n"))
    out = v.join(t, keys, "full_outer")
    return out.withColumn("total", VECTOR * F.coalesce("score", F.lit(0.0)) + LEXICAL * F.coalesce("n", F.lit(0)))


def ranked(vector_hits: DataFrame, lexical_hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One list a query: query_id, id, total, channel, rank; what only one channel finds is there as well."""
    both = merge_channels(vector_hits, lexical_hits, ["query_id", "id"])
    channel = F.when(F.col("n").isNull(), "vector").when(F.col("score").isNull(), "lexical").otherwise("both")
    w = W.partitionBy("query_id").orderBy(F.round("total", 9).desc(), "id")
    return both.withColumns({"channel": channel, "rank": F.row_number().over(w)}).where(F.col("rank") <= limit)


def graph_boost(hits: DataFrame, edges: DataFrame, roots: int = 3) -> DataFrame:
    """hits(parent, score, nth) and edges(relation, src, dst): each edge of the top roots' neighbourhoods lifts its first hit.

    The lift is GRAPH / (1 + nodes of the neighbourhood).
    """
    top = hits.where(F.col("nth") <= roots).select(F.col("parent").alias("root"))
    both = edges.select(F.col("src").alias("root"), "relation", "src", "dst").union(edges.select(F.col("dst").alias("root"), "relation", "src", "dst"))
    near = both.join(F.broadcast(top), "root")  # at most `roots` rows
    nodes = near.select("root", F.explode(F.array("src", "dst")).alias("n")).groupBy("root").agg(F.countDistinct("n").alias("nodes"))
    lift = near.join(nodes, "root").select("root", "relation", "src", "dst", (GRAPH / (1 + F.col("nodes"))).alias("lift"))
    key = ["root", "relation", "src", "dst"]
    ends = lift.select(*key, F.explode(F.array_distinct(F.array("src", "dst"))).alias("parent"), "lift")
    first = ends.join(hits.select("parent", "nth"), "parent").groupBy(*key).agg(F.min_by("parent", "nth").alias("parent"), F.max("lift").alias("lift"))
    return hits.join(first.groupBy("parent").agg(F.sum("lift").alias("lift")), "parent", "left").withColumn("boosted", F.col("score") + F.coalesce("lift", F.lit(0.0)))


# --- one list of hits over all channels --------------------------------------------------------------

#: A hit of any channel: what it is of (kind:source:key), how well it fits, how often, and what is shown of it.
HIT = ("query_id", "parent", "channel", "value", "ordinal", "excerpt")
CHANNELS = ("vector", "chunk", "symbol", "document")


def hits(found: DataFrame, channel: str, parent: Column, value: Column | None = None, ordinal: Column | None = None, excerpt: Column | None = None) -> DataFrame:
    """found with a query_id as rows of HIT; the value is a score for vectors and 1 for each row that holds the needle."""
    blank = F.lit(None).cast("string")
    return found.select("query_id", parent.alias("parent"), F.lit(channel).alias("channel"), (F.lit(1.0) if value is None else value).cast("double").alias("value"), (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"), (blank if excerpt is None else excerpt).alias("excerpt"))


def fused(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """HIT rows of all channels -> one list a query: query_id, parent, one column for each channel, ordinal, excerpt, score, nth.

    A parent's score is the weighted best of its vectors and the weighted number of its other hits. The excerpt is
    that of its first hit with one, in the order of CHANNELS.
    """
    at = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    shown = F.min(F.when(F.col("excerpt").isNotNull(), F.struct(at.alias("at"), "ordinal", "excerpt")))
    of = lambda c, agg: agg(F.when(F.col("channel") == c, F.col("value"))).alias(c)
    out = found.groupBy("query_id", "parent").agg(of("vector", F.max), *(of(c, F.sum) for c in CHANNELS[1:]), F.min("ordinal").alias("ordinal"), shown.alias("shown"))
    text = sum((F.coalesce(c, F.lit(0.0)) for c in CHANNELS[1:]), F.lit(0.0))
    out = out.withColumn("score", VECTOR * F.coalesce("vector", F.lit(0.0)) + LEXICAL * text)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "parent"))
    return out.withColumn("nth", nth).where(F.col("nth") <= limit).select("query_id", "parent", *CHANNELS, "ordinal", F.col("shown.excerpt").alias("excerpt"), "score", "nth")


def lifted(lists: DataFrame, edges: DataFrame, roots: int = 3, neighbors: int = NEIGHBORS, limit: int = LIMIT) -> DataFrame:
    """Lists of fused() with a graph lift, ranked anew: also lift, truncated, rank.

    The first hits of each list are roots. An edge of a root's neighbourhood lifts the first hit of the list that is
    one of its ends, by GRAPH / (1 + nodes of that neighbourhood). A neighbourhood has at most `limit` nodes, the
    root among them; the edge that would bring one more is its last. A list is truncated if it or a neighbourhood is.
    lists and edges are used more than once: hand them over as written tables where they are dear to compute.
    """
    top = lists.where(F.col("nth") <= roots).select("query_id", F.col("parent").alias("root"))
    near = graph.around(edges, top.select(F.col("root").alias("node")), neighbors, limit)
    lift = GRAPH / (1 + F.least(1 + F.col("others"), F.lit(limit)))
    sized = near.select(F.col("node").alias("root"), "other", "at", lift.alias("lift"), (F.col("others") >= limit).alias("cut"))
    of_list = top.join(sized, "root")
    ends = of_list.select("query_id", "root", "at", "lift", F.explode(F.array_distinct(F.array("root", "other"))).alias("parent"))
    first = ends.join(lists.select("query_id", "parent", "nth"), ["query_id", "parent"]).groupBy("query_id", "root", "at").agg(F.min_by("parent", "nth").alias("parent"), F.max("lift").alias("lift"))
    lift = first.groupBy("query_id", "parent").agg(F.sum("lift").alias("lift"))
    cut = of_list.groupBy("query_id").agg(F.max("cut").alias("cut"))
    out = lists.join(lift, ["query_id", "parent"], "left").join(cut, "query_id", "left").withColumn("lift", F.coalesce("lift", F.lit(0.0)))
    whole = W.partitionBy("query_id")
    out = out.withColumns({"score": F.col("score") + F.col("lift"), "truncated": F.coalesce("cut", F.lit(False)) | (F.count(F.lit(1)).over(whole) >= limit)}).drop("cut")
    return out.withColumn("rank", F.row_number().over(whole.orderBy(F.round("score", 9).desc(), "nth")))


def explored(symbols: DataFrame, documents: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = LIMIT, roots: int = 3) -> DataFrame:
    """Hits of two channels and the graph around the best of each, for every query at once.

    symbols, documents (query_id, id, source_filter, and nth: their order in the channel) -> query_id, section
    (symbol, document, related), root, id, relation, direction, label, truncated, source_filter. The filter is
    what the caller asked for, given back. truncated holds for the whole bundle: a channel or a neighbourhood is full.
    """
    s, d = (x.where(F.col("nth") <= limit).select("query_id", "id", "source_filter", "nth", F.lit(name).alias("section")) for x, name in ((symbols, "symbol"), (documents, "document")))
    found = s.unionByName(d)
    top = found.where(F.col("nth") <= roots).select("query_id", "source_filter", F.col("id").alias("root")).distinct()
    near = graph.around(edges, top.select(F.col("root").alias("node")), NEIGHBORS, limit)
    related = top.join(near.withColumnRenamed("node", "root"), "root")
    full = found.groupBy("query_id", "section").agg((F.count(F.lit(1)) >= limit).alias("full")).unionByName(related.select("query_id", F.lit("").alias("section"), (F.col("place") >= limit).alias("full"))).groupBy("query_id").agg(F.max("full").alias("truncated"))
    blank = F.lit(None).cast("string")
    rows = found.select("query_id", "section", blank.alias("root"), "id", blank.alias("relation"), blank.alias("direction"), "source_filter")
    rows = rows.unionByName(related.where(F.col("place") < limit).select("query_id", F.lit("related").alias("section"), "root", F.col("other").alias("id"), "relation", "direction", "source_filter"))
    return rows.join(nodes.select("id", F.coalesce("title", "name", "key").alias("label")), "id", "left").join(full, "query_id")
