"""What a user asks of an indexed graph; decisions and their notes."""

from __future__ import annotations

import json

import pytest

from loomgraph.functions.embed import HashEmbedder
from loomgraph.jobs.facade import LEGEND, Graph, as_json
from loomgraph.jobs.index import Settings, index
from loomgraph.operators.store import Store
from loomgraph.sources.connectors import Source

FILES = {
    "code/lib/winch.rb": "module Winch\n  class Drum\n    def reel\n      brake(1)\n    end\n  end\nend\n",
    "code/lib/brake.rb": "def brake(n)\n  n\nend\n",
    "notes/Rigging.md": "# Rigging\nThe Drum turns. See [[Knots]].\n",
    "notes/Knots.md": "---\ntitle: Knots\naliases: [bends]\n---\nbrake before you tie; a drum of rope.\n",
}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("facade")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "empty").mkdir()
    sources = [Source("code", "code", f"{root}/code"), Source("notes", "notes", f"{root}/notes"), Source("empty", "notes", f"{root}/empty")]
    embedder = HashEmbedder(16)
    store = Store(spark, f"file://{root}/store", 4)
    index(spark, store, sources, Settings(embedder=embedder))
    return root, sources, Graph(store, embedder)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_sources_and_status(world):
    _, _, g = world
    assert [tuple(r) for r in g.list_sources().select("name", "kind", "files", "symbols", "documents").collect()] == [("code", "code", 2, 4, 0), ("empty", "notes", 0, 0, 0), ("notes", "notes", 0, 0, 2)]
    counts = dict(map(tuple, g.status().collect()))
    assert counts["file"] == 4 and counts["symbol"] == 4 and counts["document"] == 2 and counts["decision"] == 0
    assert g.legend().count() == len(LEGEND)
    shown = [json.loads(r.json) for r in as_json(g.list_sources().drop("last_indexed")).collect()]
    assert shown[1]["name"] == "empty" and shown[1]["files"] == 0


def test_lexical_search(world):
    _, _, g = world
    assert [r.fqn for r in g.search_symbols("WINCH").collect()] == ["lib::winch::Winch", "lib::winch::Winch::Drum", "lib::winch::Winch::Drum::reel"]
    hit = g.search_symbols("brake", 1).first()
    assert (hit.token, hit.signature, hit.path, hit.start_line, hit.end_line) == ("symbol:code:lib::brake::brake", "def brake(n)", "lib/brake.rb", 1, 3)
    assert g.search_symbols("brake", sources=["notes"]).count() == 0 and g.search_symbols(" ").count() == 0
    found = {r.path: r.excerpt for r in g.search_documents("drum").collect()}
    assert set(found) == {"Rigging.md", "Knots.md"} and "**Drum**" in found["Rigging.md"] and "**drum**" in found["Knots.md"]


def test_semantic_search(world):
    _, _, g = world
    got = g.semantic_search("drum").collect()
    top = {r.parent: r for r in got}
    assert {r["mode"] for r in got} == {"hybrid"} and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    both, note = top["symbol:code:lib::winch::Winch::Drum"], top["document:notes:Rigging.md"]
    assert both.symbol == 1 and both.chunk == 1 and both.vector > 0 and note.document == 1 and note.chunk == 1
    assert all(r.vector is not None for r in got) and any(r.lift > 0 for r in got)
    exact = g.semantic_search("function brake\nlib::brake::brake\ndef brake(n)\nfile lib/brake.rb").first()
    assert exact.parent == "symbol:code:lib::brake::brake" and round(exact.vector, 6) == 1
    plain = Graph(g.store).semantic_search("drum", sources=["notes"]).collect()
    assert {r["mode"] for r in plain} == {"fts"} and {r.parent for r in plain} == {"document:notes:Rigging.md", "document:notes:Knots.md"} and all(r.vector is None for r in plain)
    assert Graph(g.store).semantic_search("nothing of that").count() == 0


def test_graph_and_context(world):
    _, _, g = world
    near = g.graph_neighbors("symbol:code:lib::winch::Winch::Drum", 1)
    assert ("mentions", "document:notes:Rigging.md", "symbol:code:lib::winch::Winch::Drum", "Rigging", "Drum", False) in rows(near, "relation", "src", "dst", "src_label", "dst_label", "truncated")
    assert g.graph_neighbors("symbol:code:none").count() == 0 and g.graph_neighbors("nonsense").count() == 0
    assert all(r.truncated for r in g.graph_neighbors("file:code:lib/winch.rb", 2, 2).collect())
    bundle = g.explore_context("drum", sources=["code", "notes"]).collect()
    assert {r.id for r in bundle if r.section == "symbol"} == {"symbol:code:lib::winch::Winch::Drum", "symbol:code:lib::winch::Winch::Drum::reel"} and {r.id for r in bundle if r.section == "document"} == {"document:notes:Rigging.md", "document:notes:Knots.md"}
    assert {r.source_filter for r in bundle} == {"code,notes"} and not any(r.truncated for r in bundle)
    assert ("document:notes:Rigging.md", "symbol:code:lib::winch::Winch::Drum", "mentions", "Drum") in {(r.root, r.id, r.relation, r.label) for r in bundle}
    assert all(r.truncated for r in g.explore_context("drum", 1).collect())


def test_promotion(world):
    root, sources, g = world
    mention = "document:notes:Knots.md"
    assert g.promote_mentions(0.95) == 0
    assert g.promote_mentions(0.5, document=mention) == 1 and g.promote_mentions(0.5, document=mention) == 0
    assert rows(g.store.read("edge").where("relation = 'explains'"), "src", "dst", "promoted_from", "confidence") == {(mention, "symbol:code:lib::brake::brake", f"mentions:{mention}:symbol:code:lib::brake::brake", 0.9)}
    # it outlives a run that links the same document anew, but not a change of the document
    (root / "code/lib/more.rb").write_text("def rope\nend\n")
    assert index(g.spark, g.store, sources, Settings(embedder=g.embedder))["notes"]["indexed"] == 0
    explains = g.store.read("edge").where("relation = 'explains'")
    assert explains.count() == 1 and ("mentions", "symbol:code:lib::more::rope") in rows(g.store.read("edge").where(f"src = '{mention}'"), "relation", "dst")
    (root / "notes/Knots.md").write_text(FILES["notes/Knots.md"] + "More.\n")
    index(g.spark, g.store, sources, Settings(embedder=g.embedder))
    assert g.store.read("edge").where("relation = 'explains'").count() == 0


def test_decisions(spark, world):
    root, sources, g = world
    made = lambda *r: spark.createDataFrame(list(r), "title string, body string, about array<string>")
    targets = ["symbol:code:lib::brake::brake", "DOCUMENT:notes:Knots.md", "symbol:code:gone", "odd"]
    assert g.add_decisions(made((" Brake first ", "Always.", targets), ("Use rope: yes!", "It holds.", None)), vault=sources[1]) == {"decisions": 2, "about_linked": 2, "notes": 2}
    note = (root / "notes/decisions/brake-first.md").read_text()
    assert note.startswith("---\ntitle: Brake first\ntags: [adr]\ncreated: ") and note.endswith("# Brake first\n\nAlways.\n\n## About\n\n- `symbol:code:lib::brake::brake`\n- `document:notes:Knots.md`\n- `symbol:code:gone`\n\n")
    assert sorted(p.name for p in (root / "notes/decisions").iterdir()) == ["brake-first.md", "use-rope-yes.md"]
    # the same title again replaces the row, its edges and its file
    assert g.add_decisions(made(("Brake first", "Never.", targets[:1])), vault=sources[1])["about_linked"] == 1
    assert rows(g.store.read("decision"), "title", "body") == {("Brake first", "Never."), ("Use rope: yes!", "It holds.")}
    assert rows(g.store.read("edge").where("relation = 'about'"), "src", "dst") == {("decision:system:Brake first", "symbol:code:lib::brake::brake")}
    assert "Never." in (root / "notes/decisions/brake-first.md").read_text() and len(list((root / "notes/decisions").iterdir())) == 2
    near = g.graph_neighbors("adr:system:Brake first", 1)
    assert ("about", "Brake first", "brake") in rows(near, "relation", "src_label", "dst_label")
    for bad in (("", "x", None), ("x", "  ", None), (None, "x", None)):
        with pytest.raises(ValueError):
            g.add_decisions(made(bad))
    with pytest.raises(ValueError):
        g.add_decisions(made(("x", "y", None)), vault=sources[0])


def test_health(world):
    root, sources, g = world
    got = {r.name: r.status for r in g.health([*sources, Source("later", "notes", f"{root}/none"), Source("odd", "other", "x")]).collect()}
    assert got == {"store.schema": "ok", "source:code": "ok", "source:notes": "ok", "source:empty": "ok", "source:later": "warn", "source:odd": "fail", "vectors": "ok"}
    assert {r.name: r.status for r in Graph(g.store, HashEmbedder(32)).health([]).collect()} == {"store.schema": "ok", "sources": "warn", "vectors": "fail"}
