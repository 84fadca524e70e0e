"""Extraction functions on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import code, markup, text
from loomgraph.functions.embed import HashEmbedder, embed_chunks
from loomgraph.sources import services


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr).first()[0]


@pytest.mark.parametrize(("body", "keys"), [
    ("Closes QX-901, later QX-901 and DEPOT-7 again", ["QX-901", "DEPOT-7"]), ("xQX-901 QX-1234567 Q-1 aB-2", []), ("AbC9-1.", ["AbC9-1"]), ("", []), (None, None),
])
def test_issue_keys(spark, body, keys):
    assert one(spark, text.issue_keys(F.col("b")), b=body) == keys


def test_identifiers(spark):
    assert one(spark, text.identifiers(F.col("b")), b="Foo: a::b x _y1, é") == ["Foo:", "a::b", "_y1"]


NOTE = "---\r\ntitle: 'Loading plan'\naliases: [Stowage, \"Cargo list\"]\ntags:\n  - hold\n  - 'x y'\n---\n# Heading\nSee [[Ballast|b]] and ![[chart.png]] [[dir\\Ropes#part]] [[ ]] [[Ballast]] #inline-tag, #2\n"


def test_notes(spark):
    d = spark.createDataFrame([(NOTE,), ("plain\n## Top\ntext",), (None,)], "raw string").select(text.front_matter(F.col("raw")).alias("n")).select("n.*")
    head, body = F.col("head"), F.col("body")
    rows = d.select(text.head_value(head, "title").alias("title"), text.head_list(head, "aliases").alias("aliases"), text.head_list(head, "tags").alias("tags"), text.first_heading(body).alias("h"), text.wikilinks(body).alias("links"), text.inline_tags(body).alias("inline")).collect()
    assert rows[0].title == "Loading plan" and rows[0].aliases == ["Stowage", "Cargo list"] and rows[0].tags == ["hold", "x y"] and rows[0].h == "Heading"
    assert rows[0].links == ["Ballast", "dir/Ropes", "Ballast"] and rows[0].inline == ["inline-tag", "2"]
    assert rows[1].title is None and rows[1].h == "Top" and rows[1].aliases == []


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (1200, 1), (1201, 2), (2250, 2), (2251, 3)])
def test_chunks(spark, n, count):
    got = one(spark, text.chunks(F.col("b")), b=" " + "x" * n + "\n")
    assert len(got) == count and sum(map(len, got)) - 150 * max(0, count - 1) == n


@pytest.mark.parametrize("n", [0, 1, 1200, 1201, 2251])
def test_chunk_rows(spark, n):
    body = " " + "".join(chr(97 + i % 26) for i in range(n)) + "\n"
    d = spark.createDataFrame([(1, body), (2, None)], "id int, b string")
    got = [r.chunk for r in text.chunk_rows(d, "b").orderBy("ordinal").collect()]
    assert got == one(spark, text.chunks(F.col("b")), b=body)


def test_chunk_rows_of_a_very_long_text(spark):
    d = spark.range(1).select(F.repeat(F.lit("abcdé "), 850_000).alias("b"))
    assert text.chunk_rows(d, "b").agg(F.count("*"), F.sum(F.length("chunk"))).first()[0] == 1 + -(-(5_099_999 - 1200) // 1050)


def test_excerpt(spark):
    assert one(spark, text.excerpt(F.col("b"), "Needle"), b="a NEEDLE\nb") == "a **NEEDLE** b"
    long = one(spark, text.excerpt(F.col("b"), "needle"), b="x" * 100 + "needle" + "y" * 200)
    assert long.startswith("…") and long.endswith("…") and "**needle**" in long
    assert one(spark, text.excerpt(F.col("b"), "needle"), b="none") is None


def test_paths(spark):
    f = spark.createDataFrame([("src/lib/mod.rs",), ("web/App.tsx",), ("Rakefile",), ("a.b/c",)], "p string").select(text.language(F.col("p")).alias("l"), text.module_path(F.col("p")).alias("m"), text.excluded(F.col("p"), ("**/web/**", "*")).alias("x")).collect()
    assert [r.l for r in f] == ["rust", "typescript", "ruby", None]
    assert [r.m for r in f][:2] == ["src::lib", "web::App"] and [r.x for r in f] == [False, True, False, False]


def test_tokens(spark):
    assert tuple(one(spark, text.parse_token(F.col("t")), t="symbol:code:a::b")) == ("symbol", "code", "a::b")
    assert one(spark, text.slug(F.col("t")), t=" Use Spark, not X! ") == "use-spark-not-x" and one(spark, text.slug(F.col("t")), t="--") == "adr"
    assert len(one(spark, text.record_id(F.col("t")), t="x")) == 32


def test_adf():
    doc = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "T"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i"}]}]}]}, {"type": "media"}, {"type": "rule"}]}
    assert markup.adf_text(doc).strip() == "## T\na\nb\n- i\n---"


SOURCES = {
    "python": ("import json\nfrom .shelf import weigh\n\nclass Depot:\n    def stock(self):\n        weigh('crate')\n        json.dumps([])\n", ["m::Depot", "m::Depot::stock"], ["json", ".shelf"], {("m::Depot::stock", "weigh"), ("m::Depot::stock", "dumps")}),
    "rust": ("mod shelf;\nuse crate::shelf::weigh;\n\npub fn load() -> u64 {\n    weigh(7)\n}\nstruct Crate { kg: u64 }\nimpl Crate {\n    fn lift(&self) -> u64 {\n        pulley()\n    }\n}\n", ["m::shelf", "m::load", "m::Crate", "m::lift"], ["crate::shelf::weigh"], {("m::load", "weigh"), ("m::lift", "pulley")}),
    "typescript": ("import { weigh } from '../shelf';\n\nexport function load(): number {\n  return weigh(7);\n}\nexport const sort = (kg: number) => {\n  load();\n};\ninterface Crate {}\n", ["m::load", "m::sort", "m::Crate"], ["../shelf"], {("m::load", "weigh"), ("m::sort", "load")}),
    "ruby": ("require 'depot/shelf'\n\nmodule Depot\n  class Crane\n    def lift\n      Pulley.build.haul\n    end\n  end\nend\n", ["m::Depot", "m::Depot::Crane", "m::Depot::Crane::lift"], ["depot/shelf"], {("m::Depot::Crane::lift", "build"), ("m::Depot::Crane::lift", "haul")}),
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_code(lang):
    source, symbols, imports, calls = SOURCES[lang]
    rows = code.parse(source, "m", lang)
    assert [r[3] for r in rows if r[0] == "symbol"] == symbols
    assert [r[6] for r in rows if r[0] == "import"] == imports
    assert {(r[3], r[6]) for r in rows if r[0] == "call"} == calls


def test_code_batches(spark):
    df = spark.createDataFrame([("src/m.py", "python", bytearray(b"def f():\n    g()\n")), ("bad.py", "python", bytearray(b"def ("))], "id string, language string, content binary")
    assert {(r.id, r.what, r.fqn) for r in code.symbols(df).collect()} == {("src/m.py", "symbol", "src::m::f"), ("src/m.py", "call", "src::m::f")}


def test_incremental_query():
    assert services.incremental_query("project = A ORDER BY created", "2026/01/01 00:00") == '(project = A) AND updated >= "2026/01/01 00:00" ORDER BY updated ASC'
    assert services.incremental_query("", None) == "updated >= -3650d ORDER BY updated ASC"


def test_embedded_in_doubles(spark):
    d = spark.range(20).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    want = HashEmbedder(16).embed([f"text {i}" for i in range(20)])
    got = embed_chunks(d, HashEmbedder(16)).orderBy("id").collect()
    assert [r.embedding for r in got] == want.tolist()
