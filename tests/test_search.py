"""Nearest neighbours in blocks, one list over all channels, neighbourhoods in total."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import graph, search


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None)], "vec_id long, embedding array<double>")
    assert {r.id: r.nth for r in search.nearest(v, v.where("vec_id = 3"), 2).collect()} == {3: 1, 1: 2}
    for groups in (1, 4):
        two = search.nearest(v, v.where("vec_id in (1, 3)"), 1, block=1, groups=groups)
        assert rows(two, "query_id", "id") == {(1, 1), (3, 3)}
    assert search.nearest(v, v.where("false")).count() == 0 and search.nearest(v.where("false"), v).count() == 0
    named = v.select(F.concat(F.lit("é"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding")
    assert rows(search.nearest(named, named.where("vec_id = 'é3'"), 2), "id", "nth") == {("é3", 1), ("é1", 2)}


def test_nearest_plan_does_not_grow(spark):
    """The plan is the same for ten queries and for many, and the rows are those of all pairs."""
    v = spark.range(700).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in (1, 2, 3))).alias("embedding"))
    plans = [re.sub(r"#\d+L?|\d+", "", search.nearest(v, v.where(f"vec_id < {n}"))._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 100_000)]
    assert plans[0] == plans[1]
    got = {(r.query_id, r.nth): r.id for r in search.nearest(v, v, 3, block=64).collect()}
    m = np.array([r.embedding for r in v.orderBy("vec_id").collect()])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - m @ m.T, 9)
    want = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), axis=1)[:, :3]
    assert got == {(q, n + 1): int(want[q, n]) for q in range(700) for n in range(3)}


def test_one_list_over_all_channels(spark):
    """Weights, counts, excerpts, the list's end; a lift goes to the first hit that is an end of the edge."""

    def hit(channel, *given):
        d = spark.createDataFrame([(0, *r) for r in given], "query_id int, p string, v double, o int, x string")
        return search.hits(d, channel, F.col("p"), F.col("v"), F.col("o"), F.col("x"))

    found = hit("vector", ("d", 0.5, 3, "far"), ("d", 0.9, 1, "near"), ("e", 0.9, 0, None)).unionByName(hit("chunk", ("d", 1.0, 2, "**c**"), ("d", 1.0, 4, "later"), ("s", 1.0, 0, None))).unionByName(hit("symbol", ("s", 1.0, 0, "sig")))
    got = {r.parent: r for r in search.fused(found).collect()}
    assert {p: (round(r.score, 6), r.nth, r.excerpt, r.ordinal) for p, r in got.items()} == {"d": (0.74, 1, "near", 1), "e": (0.54, 2, None, 0), "s": (0.2, 3, "sig", 0)}
    assert rows(search.fused(found, 1), "parent") == {("d",)}
    edges = spark.createDataFrame([("mentions", "s", "e"), ("mentions", "x", "s")], "relation string, src string, dst string")
    up = {r.parent: r for r in search.lifted(search.fused(found), edges).collect()}
    # e's neighbourhood is e and s, that of s is s, e and x: the edge of e and s lifts e twice, that of x and s lifts s
    assert {p: round(r.lift, 6) for p, r in up.items()} == {"d": 0, "e": round(0.3 / 3 + 0.3 / 4, 6), "s": round(0.3 / 4, 6)}
    assert {p: r.rank for p, r in up.items()} == {"d": 1, "e": 2, "s": 3} and not any(r.truncated for r in up.values())
    assert search.lifted(search.fused(found, 3), edges, limit=3).where("truncated").count() == 3


def test_neighbors_in_total(spark):
    e = spark.createDataFrame([("b", "r", "1"), ("b", "r", "2"), ("a", "r", "3"), ("a", "4", "r"), ("c", "r", "5")], "relation string, src string, dst string")
    root = spark.createDataFrame([("r",)], "node string")
    assert [r.other for r in graph.neighbors(e, root, 25, 3).orderBy("at").collect()] == ["4", "3", "1"]
    assert [r.other for r in graph.neighbors(e, root, 1, 3, ("c", "b")).orderBy("at").collect()] == ["5", "1", "4"]


def test_neighborhood_of_a_hub(spark):
    """A hub is cut before the join, and what it leaves out can't be among the first."""
    e = spark.createDataFrame([("x", "hub", f"n{i:03d}") for i in range(300)] + [("x", f"r{i}", "hub") for i in range(5)], "relation string, src string, dst string")
    roots = spark.createDataFrame([("r0",), ("n150",), ("hub",)], "node string")
    steps: dict[str, set[str]] = {}
    for r in e.collect():
        steps.setdefault(r.src, set()).add(r.dst)
        steps.setdefault(r.dst, set()).add(r.src)
    want = set()
    for root in ("r0", "n150", "hub"):
        one = sorted(steps[root] - {root})
        two = sorted({z for y in one for z in steps[y]} - {root, *one})
        want |= {(root, n) for n in [root, *one, *two][:10]}
    assert rows(graph.neighborhood(e, roots, 2, 10), "root", "node") == want
