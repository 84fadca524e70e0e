"""Markup, notes and block trees as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomgraph.functions import markup, text
from loomgraph.sources import services
from loomgraph.sources.connectors import note_fields
from tests.test_functions import NOTE

HTML = [
    ("<html><style>p{}</style><h1>A &amp; B</h1><p>caf&eacute; <b>b</b>&nbsp;x</p><script>var t='</p>'</script><!-- no --><p>ñ</p>", "A & B\ncafé b x\nñ"),
    ("", ""), (None, ""), ("<p", ""), ("a &amp;lt; &#38;amp; &#x41;&#66; &#xD800; &#99999999; &nope; & &;", "a &lt; &amp; AB &#xD800; &#99999999; &nope; & &;"),
    ("<p>one</p>\n\n\n<p>two</p>\n", "one\n\ntwo"), ("x<br>y<BR/>z<div\nclass='a'>w", "x\ny\nz\nw"), ("a\r\n 　b", "a\nb"), ("&#128512;", "\U0001f600"),
]


def test_html(spark):
    d = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(HTML)], "i int, h string").select("i", markup.html_text(F.col("h")).alias("t"))
    assert {r.i: r.t for r in d.collect()} == {i: y for i, (_, y) in enumerate(HTML)}


def test_note_fields(spark):
    """Each part of a note is computed once, and all links are kept."""
    d = note_fields(spark.createDataFrame([(NOTE,), ("# Top\n[[a]]",), (None,), ("---\n---\nx",)], "raw string"), "raw", F.lit("dir/File.md"))
    rows = {r.title: r for r in d.collect()}
    assert rows["Loading plan"].links == ["Ballast", "dir/Ropes", "Ballast"] and rows["Loading plan"].tags == ["hold", "x y", "inline-tag", "2"] and rows["Loading plan"].body.startswith("# Heading")
    assert rows["Top"].body == "# Top\n[[a]]" and rows["Top"].links == ["a"] and "File" in rows
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(raw") == 1


def test_folded(spark):
    d = spark.createDataFrame([("a/./b//c",), ("a/../b",), ("../a",), ("a/../../b",), ("./x\\y",), ("",), (None,)], "p string").select(text.folded(F.col("p")).alias("f"))
    assert [r.f for r in d.collect()] == ["a/b/c", "b", None, None, "x/y", "", None]


def test_canonical_tokens(spark):
    given = ["ADR:system:Use: it", "architecture_decision:s:k", "symbol:code:a::b", "chunk:a:b", "symbol::k", "symbol:a", None]
    d = spark.createDataFrame([(x,) for x in given], "t string").select(text.canonical_token(F.col("t")).alias("t"))
    assert [r.t for r in d.collect()] == ["decision:system:Use: it", "decision:s:k", "symbol:code:a::b", None, None, None, None]


def test_blocks(spark):
    runs = [{"plain_text": "x"}, {"plain_text": "y"}]
    blocks = [
        ({"type": "heading_2", "heading_2": {"rich_text": runs}}, "## xy\n\n"), ({"type": "to_do", "to_do": {"rich_text": runs, "checked": True}}, "- [x] xy\n"), ({"type": "to_do", "to_do": {"text": runs}}, "- [ ] xy\n"),
        ({"type": "paragraph", "paragraph": {"rich_text": []}}, ""), ({"type": "paragraph", "paragraph": {"rich_text": runs}}, "xy\n\n"), ({"type": "numbered_list_item", "numbered_list_item": {"rich_text": runs}}, "- xy\n"),
        ({"type": "code", "code": {"rich_text": runs, "language": "ruby"}}, "```ruby\nxy\n```\n\n"), ({"type": "child_page", "child_page": {"title": "T"}}, "[page: T]\n\n"), ({"type": "child_database", "child_database": {}}, "[database: database]\n\n"),
        ({"type": "bookmark", "bookmark": {"url": "u"}}, "u\n\n"), ({"type": "embed", "embed": {}}, ""), ({"type": "image", "image": {"rich_text": runs}}, ""), ({"type": "divider"}, "---\n\n"), ({"type": "other", "other": {"rich_text": runs}}, "xy\n"), ({}, ""),
    ]
    d = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(blocks)], "i int, b string").select("i", markup.block_text(F.col("b")).alias("t"))
    assert {r.i: r.t for r in d.collect()} == {i: x for i, (_, x) in enumerate(blocks)}
    titles = [{"B": {"type": "title", "title": runs}, "A": {"type": "title", "title": [{"plain_text": " "}]}}, {"A": {"type": "number", "number": 3}}, {}]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(titles)], "i int, p string").select("i", markup.page_title(F.col("p")).alias("t"))
    assert {r.i: r.t for r in d.collect()} == {0: "xy", 1: "Untitled", 2: "Untitled"}


def test_block_trees(spark):
    """Against recursion: three levels below the first, the last block of a full parent without its children, a cycle, a child page."""
    blocks = {
        "p": [("a", "toggle", True), ("b", "child_page", True), ("c", "toggle", True)], "a": [(f"a{i}", "toggle", i in (0, 3, 4)) for i in range(6)], "a0": [("d", "toggle", True)], "a3": [("y", "toggle", False)], "a4": [("n", "toggle", False)],
        "d": [("e", "toggle", True)], "e": [("f", "toggle", False)], "c": [("c", "toggle", True)], "b": [("z", "toggle", False)],
    }

    def walk(parent, depth=0):
        out = []
        for n, (id_, kind, more) in enumerate(blocks.get(parent, [])[:5]):
            out.append(f"[page: {id_}]" if kind == "child_page" else id_)
            if n < 4 and more and depth < 3 and kind != "child_page":
                out += walk(id_, depth + 1)
        return out

    rows = [(p, n, json.dumps({"id": i, "type": k, "has_children": more, k: {"title": i, "rich_text": [{"plain_text": i}]}})) for p, own in blocks.items() for n, (i, k, more) in enumerate(own)]
    got = services.block_texts(spark.createDataFrame([("p",), ("none",)], "id string"), spark.createDataFrame(rows, "parent string, ord int, block string"), most=5)
    assert {r.id: r.text for r in got.collect()} == {"p": "".join(f"{x}\n\n" for x in walk("p")), "none": ""}
    assert "y" in walk("p") and "n" not in walk("p") and "f" not in walk("p") and walk("p").count("c") == 4


def test_issue_times(spark):
    d = spark.createDataFrame([("2026-08-07T12:00:00.000+0000",), ("2026-08-07T14:30:00+02:00",), ("bad",), (None,)], "t string").select(services.timestamp(F.col("t")).alias("updated"))
    assert [str(r.updated) for r in d.collect()] == ["2026-08-07 12:00:00", "2026-08-07 12:30:00", "None", "None"]
    assert str(services.high_water(d).first()[0]) == "2026-08-07 12:30:00"
    assert services.updated_since(d, "2026-08-07 12:30:59").count() == 1


def test_services_without_fields(spark, tmp_path):
    """Items that lack everything but their key are documents; those without one are not."""
    (tmp_path / "1.json").write_text(json.dumps({"items": [{"key": "K-1"}, {"fields": {}}, {"key": "K-2", "fields": {"description": "plain text", "labels": None}}]}))
    (tmp_path / "2.json").write_text(json.dumps({"results": []}))
    docs = {r.path: r for r in services.issue_documents(services.items(spark, str(tmp_path)), "u/").collect()}
    assert set(docs) == {"K-1", "K-2"} and docs["K-1"].title == "K-1 — " and docs["K-1"].updated is None and docs["K-1"].tags == []
    assert docs["K-2"].body.endswith("- url: u/browse/K-2\n\n## Description\n\nplain text\n")
    wiki = spark.createDataFrame([('{"id": "9", "body": {"atlas_doc_format": {"value": "{\\"type\\":\\"doc\\",\\"content\\":[{\\"type\\":\\"paragraph\\",\\"content\\":[{\\"type\\":\\"text\\",\\"text\\":\\"tree\\"}]}]}"}, "storage": {"value": "<p>html</p>"}}}',), ("{}",)], "item string")
    got = services.wiki_documents(wiki, "w").collect()
    assert [(r.path, r.body) for r in got] == [("9", "# \n\n- page_id: `9`\n- url: w/wiki/spaces//pages/9\n\ntree\n")]
