"""The index job: all counters, links of each relation, small runs equal full ones, writes of touched partitions alone."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from loomgraph.functions.embed import HashEmbedder, embedder
from loomgraph.jobs import index as job
from loomgraph.jobs.index import COUNTERS, Settings, Source, index
from loomgraph.operators.store import Store

FILES = {
    "yard/src/dock.rs": "mod crane;\nuse crate::crane::hoist;\n\n/// Part of HARBOR-12.\npub fn unload(kg: u64) -> u64 {\n    hoist(kg, \"}\")\n}\n",
    "yard/src/crane.rs": "pub fn hoist(kg: u64, _hook: &str) -> u64 {\n    kg / 2\n}\n",
    "yard/ui/panel/board.ts": "import { paint } from '../../shared/ink';\n\nexport const show = (n: number) => {\n  paint(n);\n};\n",
    "yard/shared/ink.ts": "export function paint(n: number): void {}\n",
    "yard/gen/skip.rb": "def skipped\nend\n",
    "yard/.gitignore": "gen/\n",
    "log/Tides.md": "---\ntitle: Tide tables\naliases: [Ebb]\n---\nThe hoist waits, see [[Pilots]] and [[Nowhere]] and ![[map.png]].\n",
    "log/Pilots.md": "# Pilot duty\nBack to [[ebb]] #harbour\n",
    "board/1.json": json.dumps({"issues": [
        {"key": "HARBOR-12", "fields": {"summary": "Slow unloading", "description": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Too slow."}]}]}, "updated": "2026-03-01T08:30:10.000+0000", "labels": ["slow"], "status": {"name": "Open"}, "issuetype": {"name": "Bug"}, "priority": {"name": "High"}, "assignee": {"displayName": "Kim"}}},
        {"key": "HARBOR-13", "fields": {"summary": "Paint", "updated": "2026-03-01T09:00:59.000+0000"}},
    ]}),
    "wiki/1.json": json.dumps({"results": [{"id": 70, "title": "Quay", "space": {"key": "OPS"}, "version": {"when": "2026-02-01T00:00:00Z"}, "_links": {"webui": "/x/70"}, "metadata": {"labels": {"results": [{"name": "quay"}]}}, "body": {"storage": {"value": "<p>paint &amp; HARBOR-13</p><p>and HARBOR-99</p>"}}}]}),
    "space/1.json": json.dumps({"results": [{"object": "page", "id": "p1", "url": "u", "last_edited_time": "2026-01-01T00:00:00Z", "properties": {"Name": {"type": "title", "title": [{"plain_text": "Crew"}]}}}]}),
    "space/2.json": json.dumps({"parent": "p1", "results": [{"object": "block", "id": "b1", "type": "toggle", "has_children": True, "toggle": {"rich_text": [{"plain_text": "Who"}]}}, {"object": "block", "id": "b2", "type": "divider"}]}),
    "space/3.json": json.dumps({"parent": "b1", "results": [{"object": "block", "id": "b3", "type": "to_do", "to_do": {"rich_text": [{"plain_text": "call hoist HARBOR-12"}], "checked": True}}]}),
}


@pytest.fixture
def tree(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


def sources(tree, *names):
    made = [Source("yard", "code", f"{tree}/yard"), Source("log", "notes", f"{tree}/log"), Source("board", "issues", f"{tree}/board", url="https://t.example"), Source("wiki", "wiki", f"{tree}/wiki", url="https://w.example"), Source("space", "workspace", f"{tree}/space")]
    return [s for s in made if not names or s.name in names]


def edges(store):
    return {(r.relation, r.src, r.dst) for r in store.read("edge").collect()}


def counted(report, **want):
    return report == {**dict.fromkeys(COUNTERS, 0), **want}


def parts(store, table):
    return {str(p.parent): p.name for p in Path(store.root.removeprefix("file://"), table).rglob("part-*")}


def test_index(spark, tree):
    store = Store(spark, f"file://{tree}/store", 8)
    settings = Settings(embedder=HashEmbedder(8), promote_from=0.85)
    got = index(spark, store, sources(tree), settings)
    assert counted(got["yard"], discovered=4, indexed=4, symbols=5, imports=2, calls=2, resolves=2, chunks=5)
    assert counted(got["log"], discovered=2, indexed=2, documents=2, references=2, mentions=1, explains=1, broken_links=1, chunks=4)
    assert counted(got["board"], discovered=2, indexed=2, documents=2, chunks=4)
    assert counted(got["wiki"], discovered=1, indexed=1, documents=1, references=1, mentions=1, explains=1, chunks=2)
    assert counted(got["space"], discovered=1, indexed=1, documents=1, references=1, mentions=1, explains=1, chunks=2)
    e = edges(store)
    assert ("imports", "file:yard:src/dock.rs", "file:yard:src/crane.rs") in e and ("imports", "file:yard:ui/panel/board.ts", "file:yard:shared/ink.ts") in e
    assert ("calls", "symbol:yard:src::dock::unload", "symbol:yard:src::crane::hoist") in e and ("calls", "symbol:yard:ui::panel::board::show", "symbol:yard:shared::ink::paint") in e
    assert {x[1:] for x in e if x[0] == "references"} == {("document:log:Tides.md", "document:log:Pilots.md"), ("document:log:Pilots.md", "document:log:Tides.md"), ("document:wiki:70", "document:board:HARBOR-13"), ("document:space:p1", "document:board:HARBOR-12")}
    assert {x[1:] for x in e if x[0] == "resolves"} == {(f"symbol:yard:src::dock::{x}", "document:board:HARBOR-12") for x in ("unload", "crane")}
    assert {x[1:] for x in e if x[0] == "mentions"} == {("document:log:Tides.md", "symbol:yard:src::crane::hoist"), ("document:wiki:70", "symbol:yard:shared::ink::paint"), ("document:space:p1", "symbol:yard:src::crane::hoist")} == {x[1:] for x in e if x[0] == "explains"}
    docs = {r.path: r for r in store.read("document").collect()}
    assert docs["HARBOR-12"].body == "# Slow unloading\n\n- key: `HARBOR-12`\n- type: Bug\n- status: Open\n- priority: High\n- assignee: Kim\n- url: https://t.example/browse/HARBOR-12\n- labels: slow\n\n## Description\n\nToo slow.\n"
    assert docs["70"].body == "# Quay\n\n- space: `OPS`\n- page_id: `70`\n- url: https://w.example/wiki/x/70\n- labels: quay\n\npaint & HARBOR-13\nand HARBOR-99\n" and docs["70"].aliases == ["70", "OPS/Quay", "Quay"] and docs["70"].tags == ["quay", "OPS"]
    assert docs["p1"].body == "# Crew\n\n- page_id: `p1`\n- url: u\n\nWho\n\n- [x] call hoist HARBOR-12\n---\n\n\n" and docs["p1"].title == "Crew"
    assert all(len(r.embedding) == 8 for r in store.read("chunk").collect())
    assert store.meta("embedding_kind") == "hash" and store.meta("embedding_dimension") == "8"
    chunk = store.read("chunk").where("parent = 'symbol:yard:src::crane::hoist'").first()
    assert chunk.text == "function hoist\nsrc::crane::hoist\npub fn hoist(kg: u64, _hook: &str) -> u64\nfile src/crane.rs"
    assert {r.path: (r.kind, r.root_path) for r in store.read("source").collect()}["wiki"] == ("wiki", f"{tree}/wiki")


def test_small_runs_equal_a_full_one(spark, tree):
    store = Store(spark, f"file://{tree}/store", 8)
    own = sources(tree, "yard", "log", "wiki", "space")
    index(spark, store, own)
    before = {t: parts(store, t) for t in ("file", "symbol", "document", "edge")}
    again = index(spark, store, own)
    assert counted(again["yard"], discovered=4, skipped=4) and counted(again["log"], discovered=2, skipped=2)
    assert {t: parts(store, t) for t in before} == before
    # a name moves to another file, a note goes, a path that was wanted appears, one file alone is touched elsewhere
    (tree / "yard/src/crane.rs").write_text("pub fn winch() {}\n")
    (tree / "yard/src/mast.rs").write_text("pub fn hoist() {}\n")
    (tree / "log/Pilots.md").unlink()
    (tree / "log/Nowhere.md").write_text("A winch.\n")
    got = index(spark, store, own)
    assert (got["yard"]["indexed"], got["yard"]["skipped"], got["log"]["indexed"], got["log"]["removed"], got["log"]["skipped"]) == (2, 3, 1, 1, 1)
    fresh = Store(spark, f"file://{tree}/fresh", 8)
    index(spark, fresh, own)
    assert edges(store) == edges(fresh)
    assert ("calls", "symbol:yard:src::dock::unload", "symbol:yard:src::mast::hoist") in edges(store)
    assert ("references", "document:log:Tides.md", "document:log:Nowhere.md") in edges(store)
    for table in ("symbol", "document", "candidate", "file"):
        assert {tuple(r) for r in store.read(table).drop("updated", "aliases", "tags").collect()} == {tuple(r) for r in fresh.read(table).drop("updated", "aliases", "tags").collect()}
    # what was not touched is in the same files as before
    same = {k for k, v in parts(store, "document").items() if before["document"].get(k) == v}
    assert any("source=wiki" in k for k in same) and any("source=space" in k for k in same)
    changed = {k for k, v in parts(store, "symbol").items() if before["symbol"].get(k) != v}
    assert 0 < len(changed) <= 2


def test_a_broken_run_is_done_again(spark, tree, monkeypatch):
    """Even names that it took away from other files are linked anew by the next run."""
    store, own = Store(spark, f"file://{tree}/store", 4), sources(tree, "yard")
    index(spark, store, own)
    (tree / "yard/src/crane.rs").write_text("pub fn winch() {}\n")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr("loomgraph.jobs.index.edges", fails)
        index(spark, store, own)
    assert store.read("symbol").where("name = 'winch'").count() == 1
    assert index(spark, store, own)["yard"]["indexed"] == 1
    assert not any(x[2] == "symbol:yard:src::crane::hoist" for x in edges(store)) and store.meta("linking") == "done"


def test_given_paths_alone(spark, tree):
    store = Store(spark, f"file://{tree}/store", 8)
    own = sources(tree, "yard", "log")
    index(spark, store, own)
    (tree / "yard/src/crane.rs").write_text("pub fn hoist() -> u64 {\n    9\n}\n")
    (tree / "yard/shared/ink.ts").unlink()
    (tree / "log/Pilots.md").write_text("changed, but not among the paths\n")
    (tree / "log/New [1].md").write_text("# New\n")
    only = spark.createDataFrame([("yard", "./src/crane.rs"), ("yard", "shared/ink.ts"), ("yard", "src/dock.rs"), ("yard", "gone.rs"), ("log", "New [1].md"), ("log", "../x.md")], "source string, path string")
    got = index(spark, store, own, only=only)
    assert (got["yard"]["indexed"], got["yard"]["removed"], got["yard"]["skipped"]) == (1, 1, 1) and (got["log"]["indexed"], got["log"]["removed"]) == (1, 0)
    assert {r.path for r in store.read("file").collect()} == {"src/dock.rs", "src/crane.rs", "ui/panel/board.ts", "Tides.md", "Pilots.md", "New [1].md"}
    assert not any(x[2] == "symbol:yard:shared::ink::paint" for x in edges(store))
    assert index(spark, store, own)["log"]["indexed"] == 1


def test_issue_cursor(spark, tree):
    store, own = Store(spark, f"file://{tree}/store", 8), sources(tree, "board")
    index(spark, store, own)
    assert store.meta("issues.board.updated").startswith("2026-03-01 09:00:59")
    # an export since the cursor: one issue of that minute again, a new one; nothing that it lacks is removed
    (tree / "board/1.json").write_text(json.dumps({"issues": [{"key": "HARBOR-13", "fields": {"summary": "Paint", "updated": "2026-03-01T09:00:59.000+0000"}}, {"key": "HARBOR-14", "fields": {"summary": "New", "updated": "2026-03-02T10:00:00.000+0000"}}, {"key": "HARBOR-1", "fields": {"summary": "Old", "updated": "2026-01-01T10:00:00.000+0000"}}]}))
    got = index(spark, store, own)
    assert counted(got["board"], discovered=2, indexed=1, skipped=1, documents=1)
    assert {r.path for r in store.read("document").collect()} == {"HARBOR-12", "HARBOR-13", "HARBOR-14"} and store.meta("issues.board.updated").startswith("2026-03-02 10:00:00")
    assert counted(index(spark, store, own)["board"], discovered=1, skipped=1)
    (tree / "board/1.json").write_text(json.dumps({"issues": []}))
    assert counted(index(spark, store, own)["board"])
    assert counted(index(spark, store, own, Settings(force=True))["board"], removed=3)
    assert store.read("document").count() == 0 and store.meta("issues.board.updated") is None


def test_forced_when_chunks_are_wanted(spark, tree):
    store, own = Store(spark, f"file://{tree}/store", 8), sources(tree, "log")
    index(spark, store, own)
    assert store.read("chunk").count() == 0
    got = index(spark, store, own, Settings(embedder=HashEmbedder(8)))
    assert got["log"]["indexed"] == 2 and got["log"]["chunks"] == 4
    assert index(spark, store, own, Settings(embedder=HashEmbedder(8)))["log"]["indexed"] == 0


def test_ready_documents_are_staged_once(spark, tree, monkeypatch):
    """Bodies of given documents are written once before their table, and kinds of candidates that nothing has aren't planned."""
    staged, real = [], Store.staged
    monkeypatch.setattr(Store, "staged", lambda self, df: staged.append(df.schema.simpleString()) or real(self, df))
    store, schema = Store(spark, f"file://{tree}/store", 4), "path string, title string, aliases array<string>, tags array<string>, body string, hash string, updated timestamp"
    docs = spark.createDataFrame([(str(i), f"Page {i}", [], [], f"see KEY-{i % 3}", str(i), None) for i in range(9)], schema)
    keys = spark.createDataFrame([(f"KEY-{i}", f"KEY-{i}", [], [], "", "h", None) for i in range(2)], schema)
    index(spark, store, [Source("board", "issues", ""), Source("pages", "wiki", "")], given={"pages": docs, "board": keys})
    assert sum("body:" in x for x in staged) == 1
    assert {x for x in edges(store) if x[0] == "references"} == {("references", f"document:pages:{i}", f"document:board:KEY-{i % 3}") for i in range(9) if i % 3 < 2}
    of = store.read("file").select("source", "path")
    plan = job.edges(store, of, of, of, Settings(), {"pages": "wiki", "board": "issues"}, {"key"})._jdf.queryExecution().executedPlan().toString()
    assert "tier" not in plan


def test_bad_configurations(spark, tree):
    store = Store(spark, f"file://{tree}/store", 8)
    for bad in ([], [Source("a", "other", "x")], [Source("a", "code", "x"), Source("a", "notes", "y")]):
        with pytest.raises(ValueError):
            index(spark, store, bad)


def test_embedders():
    v = HashEmbedder(20).embed(["a", "b", "a"])
    assert v.shape == (3, 20) and abs((v**2).sum(axis=1) - 1).max() < 1e-9 and (v[0] == v[2]).all() and (v[0] != v[1]).any()
    assert not embedder("none").enabled
    with pytest.raises(ValueError):
        embedder("other")
    with pytest.raises(ValueError):
        HashEmbedder(4)
