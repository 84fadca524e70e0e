"""Linkers, graph, search, store and streams on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, link, search


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert rows(link.changes(old, new, ["path"]), "path", "status") == {("a", "skipped"), ("b", "changed"), ("c", "removed"), ("d", "added")}
    assert ("a", "changed") in rows(link.changes(old, new, ["path"], force=True), "path", "status")


def test_imports(spark):
    paths = spark.createDataFrame([("web/math.ts",), ("web/math/index.ts",), ("src/math.rs",)], "path string")
    wanted = spark.createDataFrame([(1, "web/math", 0), (1, "src/math", 1), (2, "none", 0)], "id int, base string, base_ord int")
    assert rows(link.resolve_imports(wanted, paths), "id", "path") == {(1, "web/math.ts")}


def test_calls(spark):
    calls = spark.createDataFrame([(1, "s", "weigh", "a.py"), (2, "s", "weigh", "z.py"), (3, "s", "gone", "a.py")], "call_id int, source string, name string, file string")
    symbols = spark.createDataFrame([("s", "weigh", "b.py", "b::weigh"), ("s", "weigh", "a.py", "z::weigh")], "source string, name string, file string, fqn string")
    assert rows(link.resolve_calls(calls, symbols), "call_id", "fqn") == {(1, "z::weigh"), (2, "b::weigh")}


def brute_wikilink(target, docs):
    for path, _, _ in sorted(docs):
        short = path.rsplit(".", 1)[0]
        if target in (path, short) or path.endswith("/" + target) or short.endswith("/" + target):
            return path
    for tier in (1, 2):
        for d in sorted(docs):
            names = [d[1]] if tier == 1 else d[2]
            if target.lower() in [n.lower() for n in names]:
                return d[0]
    return None


def test_wikilinks(spark):
    docs = [("yard/Crane Log.md", "Crane Log", ["Hoist"]), ("Hoist.md", "First", ["Cargo", "crane log"]), ("x/y/Deep.md", "hoist", [])]
    targets = ["Crane Log", "yard/Crane Log", "y/Deep", "Deep.md", "cargo", "FIRST", "HOIST", "crane log", "missing", "d/Crane Log"]
    two = [("a", *d) for d in docs] + [("b", "y/Deep.md", "Deep", ["cargo"])]  # a second vault with a path tail of the first
    links = spark.createDataFrame([(1, "a", x) for x in targets] + [(2, "b", x) for x in targets], "id int, source string, target string")
    got = rows(link.resolve_wikilinks(links, spark.createDataFrame(two, "source string, path string, title string, aliases array<string>")), "source", "target", "path")
    assert got == {(s, x, brute_wikilink(x, [d[1:] for d in two if d[0] == s])) for s in "ab" for x in targets}


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "Uses App::Run and Run, run: twice Run"), (2, "Run: only"), (3, None)], "doc_id int, text string")
    catalog = spark.createDataFrame([("s", "Run", "App::Run"), ("s", "Run", "Zed::Run"), ("s", "X", "App::X")], "source string, name string, fqn string")
    got = rows(link.mentions(docs, catalog), "doc_id", "fqn", "evidence", "confidence", "max_confidence")
    assert got == {(1, "App::Run", "App::Run", 1.0, 1.0)}
    assert rows(link.mentions(docs, catalog, 0.95), "doc_id", "fqn") == {(1, "App::Run")}
    assert link.promote(link.mentions(docs, catalog), 0.95).count() == 1


def test_issues_and_ends(spark):
    texts = spark.createDataFrame([("f", ["A-1", "A-1", "B-2"])], "file string, keys array<string>")
    tickets = spark.createDataFrame([("A-1", "t1")], "key string, ticket string")
    symbols = spark.createDataFrame([("f", "f::a"), ("f", "f::b")], "file string, fqn string")
    new = link.resolve_issues(texts, tickets, symbols)
    assert rows(new, "fqn", "ticket") == {("f::a", "t1"), ("f::b", "t1")}
    assert rows(link.missing(new, new.where("fqn = 'f::a'"), ["fqn", "ticket"]), "fqn") == {("f::b",)}
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "a", "gone")], "relation string, src string, dst string")
    assert rows(link.with_endpoints(edges, spark.createDataFrame([("a",), ("b",)], "id string")), "dst") == {("b",)}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("x", "a", "b"), ("x", "a", "c"), ("y", "d", "a"), ("x", "c", "e"), ("x", "e", "f"), ("x", "g", "g")], "relation string, src string, dst string")


def test_graph(spark, edges):
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.neighbors(edges, roots), "other", "relation", "direction") == {("b", "x", "out"), ("c", "x", "out"), ("d", "y", "in")}
    assert rows(graph.neighbors(edges, roots, 1), "other", "relation") == {("b", "x"), ("d", "y")}
    assert rows(graph.neighborhood(edges, roots), "node", "level") == {("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", 2)}
    cut = graph.neighborhood(edges, roots, limit=2)
    assert rows(cut, "node", "truncated") == {("a", True), ("b", True)}
    assert rows(graph.edges_within(edges, cut), "src", "dst", "truncated") == {("a", "b", True)}
    nodes = spark.createDataFrame([(x, "k", None, x, x) for x in "abcdefg"], "id string, kind string, title string, name string, key string")
    left, rest = graph.cascade_delete(nodes, edges, spark.createDataFrame([("a",)], "id string"))
    assert left.count() == 6 and rows(rest, "src") == {("c",), ("e",), ("g",)}


def test_search_predicates(spark):
    d = spark.createDataFrame([("Foo", "s1"), ("bar", "s1"), ("FOOD", "s2")], "name string, source string")
    assert d.where(search.has(" foo ", "name")).count() == 2 and d.where(search.has("  ", "name")).count() == 0
    assert [search.clamp_limit(x) for x in (None, 0, 7, 99)] == [40, 1, 7, 40] and [search.clamp_depth(x) for x in (None, 0, 9)] == [1, 1, 2]
    s = spark.createDataFrame([("git", "code"), ("vault", "notes")], "kind string, name string")
    assert search.allowed(s, None) is None and rows(search.allowed(s, ["GIT"]), "source") == {("code",)} and search.allowed(s, ["none"]).count() == 0


def test_ranked_keeps_hits_of_one_channel(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.4)], "query_id long, id long, score double")
    t = spark.createDataFrame([(1, 11, 2), (1, 12, 3)], "query_id long, id long, n long")
    assert rows(search.ranked(v, t), "id", "channel", "rank") == {(10, "vector", 1), (11, "both", 2), (12, "lexical", 3)}
    assert rows(search.ranked(v, t, 1), "id") == {(10,)}
