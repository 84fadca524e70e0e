"""Graph operators over one edge table: neighbours, bounded neighbourhoods, node descriptions, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.store import Store


def both_ways(edges: DataFrame) -> DataFrame:
    """edges(relation, src, dst) -> node, other, relation, direction: two equi-joinable halves instead of an OR."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation", F.lit("out").alias("direction"))
    return out.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation", F.lit("in").alias("direction")))


def neighbors(edges: DataFrame, roots: DataFrame, limit: int = 25, total: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """For each root at most limit edges of each relation: node, other, relation, direction, nth.

    With total also at, the edge's place among all of the root's by relation, and at most total of them; relations
    go by `order`, those not in it after the others by name.
    """
    w = W.partitionBy("node", "relation").orderBy("direction", "other")
    near = both_ways(edges).join(roots.select("node").distinct(), "node", "left_semi")
    near = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    if total is None:
        return near
    known = F.array_position(F.array(*map(F.lit, order)), F.col("relation")) if order else F.lit(0)
    place = F.row_number().over(W.partitionBy("node").orderBy(F.when(known > 0, known).otherwise(len(order) + 1), "relation", "nth"))
    return near.withColumn("at", place).where(F.col("at") <= total)


def around(edges: DataFrame, roots: DataFrame, per_relation: int = 25, limit: int = 40) -> DataFrame:
    """neighbors() in total, up to the edge that brings one node more than limit: also place, by which the other end is new, and others, how many there are."""
    near = neighbors(edges, roots, per_relation, per_relation).withColumn("_first", F.min("at").over(W.partitionBy("node", "other")))
    near = near.withColumn("place", F.dense_rank().over(W.partitionBy("node").orderBy("_first")))
    return near.withColumn("others", F.max("place").over(W.partitionBy("node"))).where(F.col("place") <= limit).drop("_first")


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 40) -> DataFrame:
    """Breadth-first from every root at once: root, node, level, truncated; at most limit nodes of a root.

    A level is one join of the frontier, of which limit + 1 nodes by node order are kept: as levels come
    before node order, no further one can be among the first limit. A root with more of them is done.
    Of a node's own neighbours the first by node order do, limit + 1 more than can have been seen: a hub is cut
    to them before it is joined, for however many roots it is near.
    """
    steps = both_ways(edges).select(F.col("node").alias("at"), "other").distinct()
    seen = roots.select(F.col("node").alias("root"), F.col("node").alias("node"), F.lit(0).alias("level")).distinct()
    frontier = seen
    by_node = W.partitionBy("root").orderBy("node")
    for level in range(1, depth + 1):
        ends = frontier.select("root", F.col("node").alias("at"))
        near = steps.join(ends.select("at").distinct(), "at", "left_semi")
        near = near.withColumn("_n", F.row_number().over(W.partitionBy("at").orderBy("other"))).where(F.col("_n") <= (level + 1) * limit + 2)
        found = ends.join(near, "at").select("root", F.col("other").alias("node")).distinct()
        fresh = found.join(seen, ["root", "node"], "left_anti").withColumn("nth", F.row_number().over(by_node)).where(F.col("nth") <= limit + 1)
        frontier = fresh.select("root", "node", F.lit(level).alias("level"))
        seen = seen.unionByName(frontier)
        frontier = frontier.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("root"))).where(F.col("n") <= limit).drop("n")
    w = W.partitionBy("root").orderBy("level", "node")
    total = F.count(F.lit(1)).over(W.partitionBy("root"))
    return seen.withColumns({"nth": F.row_number().over(w), "truncated": total > limit}).where(F.col("nth") <= limit)


def edges_within(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges whose both ends are in a root's neighbourhood: root, relation, src, dst, truncated."""
    ends = found.select("root", "node", "truncated")
    near = edges.join(ends.withColumnRenamed("node", "src"), "src")
    return near.join(ends.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi").select("root", "relation", "src", "dst", "truncated").distinct()


def describe(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(id) -> id, kind, label: title, name or key; nodes that are gone drop out."""
    return ids.select("id").distinct().join(nodes.select("id", "kind", F.coalesce("title", "name", "key").alias("label")), "id")


def cascade_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the deleted ids."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def stored_nodes(store: Store) -> DataFrame:
    """All nodes of a store: id (token), kind, source, title, name, key."""
    blank = F.lit(None).cast("string")
    node = lambda kind, table, key, title=blank, name=blank: store.read(table).select(text.token(kind, F.col("source"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), "source", title.alias("title"), name.alias("name"), F.col(key).alias("key"))
    files = store.read("file").where("kind = 'code'").select(text.token("file", F.col("source"), F.col("path")).alias("id"), F.lit("file").alias("kind"), "source", blank.alias("title"), blank.alias("name"), F.col("path").alias("key"))
    out = files.unionByName(node("symbol", "symbol", "fqn", name=F.col("name"))).unionByName(node("document", "document", "path", F.col("title"))).unionByName(node("decision", "decision", "path", F.col("title")))
    return out.groupBy("id").agg(*(F.max(c).alias(c) for c in ("kind", "source", "title", "name", "key")))


def node_ids(store: Store) -> DataFrame:
    return stored_nodes(store).select("id")
