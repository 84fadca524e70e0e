"""Registered queries over the given tables, each with the same in DuckDB SQL where SQL has it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import code, markup, text
from loomgraph.functions.embed import HashEmbedder, embed_chunks
from loomgraph.jobs.decisions import add_decisions
from loomgraph.jobs.facade import Graph
from loomgraph.jobs.index import import_bases, index
from loomgraph.operators import graph, link, search
from loomgraph.operators.store import Store, shared_folder, written
from loomgraph.sources import services
from loomgraph.sources.connectors import Source, note_fields
from loomgraph.streaming import watch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NEEDLE = "license"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- counts and status -------------------------------------------------------------------------------

@query("""
select d.source, count(*) documents, count(l.doc_id) labelled, count(distinct d.text) texts, cast(sum(d.n_chars) as bigint) n_chars
from documents d left join labels l using (doc_id) group by d.source
""")
def list_sources(spark, sf_dir):
    d, l = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has"))
    texts = d.groupBy("source", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")).agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    counts = d.select("doc_id", "source", "n_chars").join(l, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("labelled"), F.sum("n_chars").alias("n_chars"))
    return counts.join(texts, "source").select("source", "documents", "labelled", "texts", "n_chars")


@query(" union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in TABLES))
def status_counts(spark, sf_dir):
    parts = [t(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
select sha, count(*) n, min(doc_id) first_id from (select doc_id, sha256(text) sha from documents) group by sha having count(*) > 1
""")
def dup_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- lexical search ----------------------------------------------------------------------------------

@query(f"""
with h as (
  select doc_id, source, text, row_number() over (partition by source order by doc_id) nth from documents where contains(lower(text), '{NEEDLE}')
), x as (
  select doc_id, source, text, instr(lower(text), '{NEEDLE}') p, greatest(instr(lower(text), '{NEEDLE}') - 80, 1) a, length(text) n from h where nth <= 5
)
select doc_id, source, regexp_replace(
  (case when a > 1 then '…' else '' end) || substring(text, a, p - a) || '**' || substring(text, p, {len(NEEDLE)}) || '**'
  || substring(text, p + {len(NEEDLE)}, greatest(least(a + 159, n) - (p + {len(NEEDLE)}) + 1, 0)) || (case when least(a + 159, n) < n then '…' else '' end), '\n', ' ', 'g') excerpt
from x
""")
def search_documents(spark, sf_dir):
    hits = t(spark, sf_dir, "documents").where(search.has(NEEDLE, "text")).select("doc_id", "source", "text")
    return search.first_per_source(hits, [F.col("doc_id")], 5).select("doc_id", "source", text.excerpt(F.col("text"), NEEDLE).alias("excerpt"))


def catalog(spark, sf_dir) -> DataFrame:
    """Parts as symbols."""
    p = t(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("source"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_type", "p_name").alias("fqn"), F.col("p_partkey").alias("key"))


_CATALOG = "select p_brand as source, p_name as name, p_brand || '::' || p_type || '::' || p_name as fqn, p_partkey as key from part"


@query(f"""
with c as ({_CATALOG}), h as (
  select *, row_number() over (partition by source order by strlen(fqn), fqn, key) nth from c where contains(lower(fqn), '1') or contains(lower(name), '1')
) select source, name, fqn, key from h where nth <= 40 order by strlen(fqn), fqn, key limit 40
""")
def search_symbols(spark, sf_dir):
    order = [F.octet_length("fqn"), F.col("fqn"), F.col("key")]
    hits = search.first_per_source(catalog(spark, sf_dir).where(search.has("1", "fqn", "name")), order, 40)
    return hits.orderBy(*order).limit(search.clamp_limit(None)).select("source", "name", "fqn", "key")


@query("""
select d.source, count(*) n, cast(sum(n_chars) as bigint) n_chars from documents d where lower(d.source) in ('src1', 'src2', 'src3') group by d.source
""")
def source_filter(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("source", "n_chars")
    sources = d.select(F.col("source").alias("name"), F.lit("corpus").alias("kind")).distinct()
    names = search.allowed(sources, [" SRC1", "src2", "Src3", "", "absent"])
    return d.join(names, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


# --- extraction --------------------------------------------------------------------------------------

@query("""
select token, count(*) n, count(distinct doc_id) docs from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_:]{2,}')) token from documents) group by token
""")
def tokenize(spark, sf_dir):
    each = t(spark, sf_dir, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("token"))
    by_doc = each.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


_CHUNKS = r"""
with b as (select doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') body from documents),
n as (select doc_id, body, length(body) n, case when length(body) = 0 then 0 when length(body) <= 1200 then 1 else 1 + cast(ceil((length(body) - 1200) / 1050.0) as int) end k from b),
c as (select doc_id, cast(i as int) ordinal, substring(body, i * 1050 + 1, 1200) chunk from (select doc_id, body, unnest(range(k)) i from n))
"""


def _chunks(spark, sf_dir) -> DataFrame:
    return text.chunk_rows(t(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(_CHUNKS + "select doc_id, ordinal, md5(chunk) md5, length(chunk) n_chars from c")
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "ordinal", F.md5("chunk").alias("md5"), F.length("chunk").cast("long").alias("n_chars"))


@query(_CHUNKS + "select doc_id, count(*) n, cast(sum(length(chunk)) as bigint) n_chars from c group by doc_id")
def chunk_counts(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk")).alias("n_chars"))


@query(_CHUNKS + f"select doc_id, count(*) n from c where contains(lower(chunk), '{NEEDLE}') group by doc_id")
def fts_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).where(search.has(NEEDLE, "chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_ENTITY = " ".join(f"when '&{name};' then '{sign}'" for name, sign in markup.ENTITIES.items())
_HTML = rf"""
with s as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis'), '<!--.*?-->', '', 'gs') x from pages),
g as (select page_id, url, regexp_replace(regexp_replace(replace(x, chr(1), ' '), '<(?:p|br|div|h[123]|li|tr|/p|/div|/h|/li|/tr)[^>]*(?:>|\z)', chr(1), 'gi'), '<[^>]*(?:>|\z)', '', 'g') x from s),
e as (select page_id, url, regexp_replace(regexp_replace(x, chr(10) || chr(1) || '+', chr(10), 'g'), chr(1) || '+', chr(10), 'g') x from g),
p as (select page_id, url, regexp_extract_all(x, '{markup.PIECES}') pieces from e),
n as (select page_id, url, array_to_string(list_transform(pieces, lambda q: case q {_ENTITY} else
  case when regexp_full_match(q, '&#[xX][0-9a-fA-F]+;') then coalesce(chr(cast('0x' || regexp_extract(q, '[xX](.*);', 1) as int)), q)
       when regexp_full_match(q, '&#[0-9]+;') then coalesce(chr(cast(regexp_extract(q, '([0-9]+);', 1) as int)), q) else q end end), '') x from p),
w as (select page_id, url, trim(regexp_replace(regexp_replace(x, '{markup.BLANKS}', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ') x from n)
select page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '^\n+', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n+\z', '') body from w
"""


@query(_HTML)
def html_to_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", "url", markup.html_text(F.col("html")).alias("body"))


@query("""
with recursive b as (
  select conv_id, turn, case when turn = 0 then 'p' || conv_id else conv_id || ':' || ((turn - 1) // 2) end parent, conv_id || ':' || turn id,
    case role when 'user' then case when coalesce("text", '') = '' then '' else "text" || chr(10) || chr(10) end when 'assistant' then '> ' || coalesce("text", '') || chr(10) || chr(10) else '## ' || coalesce("text", '') || chr(10) || chr(10) end piece
  from conversations),
w as (select parent root, id, lpad(cast(row_number() over (partition by parent order by turn) as varchar), 3, '0') path, piece, 0 depth from b where turn = 0
  union all select w.root, c.id, w.path || c.nth, c.piece, w.depth + 1 from w join (select *, lpad(cast(row_number() over (partition by parent order by turn) as varchar), 3, '0') nth from b) c on c.parent = w.id where w.depth < 3)
select p.root id, count(w.id) n_blocks, md5(coalesce(string_agg(w.piece, '' order by w.path), '')) text_md5 from (select distinct 'p' || conv_id root from conversations) p left join w on w.root = p.root group by p.root
""")
def block_trees(spark, sf_dir):
    """Conversations as workspace pages: a turn is a block below turn (n - 1) / 2, its role the kind of block; four levels are read."""
    c = t(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "quote").otherwise("heading_2")
    id_ = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    page = F.concat(F.lit("p"), F.col("conv_id").cast("string"))
    parent = F.when(F.col("turn") == 0, page).otherwise(id_(F.expr("(turn - 1) div 2")))
    body = F.create_map(kind, F.struct(F.array(F.struct(F.coalesce("text", F.lit("")).alias("plain_text"))).alias("rich_text")))
    head = F.to_json(F.struct(id_(F.col("turn")).alias("id"), kind.alias("type"), F.lit(True).alias("has_children")))
    blocks = c.withColumns({"h": head, "m": F.to_json(body)}).select(parent.alias("parent"), F.col("turn").alias("ord"), F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(","), F.expr("substring(m, 2)")).alias("block"))
    roots = c.select(page.alias("id")).distinct()
    texts = services.block_texts(roots, blocks)
    within = F.when(F.col("turn") < 15, 1)  # the first four levels
    counts = c.groupBy(page.alias("id")).agg(F.count(within).alias("n_blocks"))
    return texts.join(counts, "id").select("id", "n_blocks", F.md5("text").alias("text_md5"))


@query(r"""
with d as (select doc_id, source, lang, '# ' || source || ' note' || chr(10) || 'See [[' || source || '/n' || doc_id || '#part|it]], [[pic.png]], [[' || lang || ' notes]] and #' || lang || '.' || chr(10) || text body from documents),
w as (select doc_id, [substring(x, 2) for x in string_split_regex(body, '[\s.,;:!?()\[\]{}]') if regexp_full_match(x, '#[A-Za-z0-9_-]+')] inline from d)
select doc_id, case when doc_id % 2 = 0 then source || ': ' || doc_id else source || ' note' end title, case when doc_id % 2 = 0 then 'd' || doc_id else '' end aliases,
  (select string_agg(x, ',' order by x) from (select distinct unnest(case when doc_id % 2 = 0 then list_concat([source, 'lang-' || lang], inline) else inline end) x)) tags,
  source || '/n' || doc_id || ',' || lang || ' notes' links, md5(body) body_md5
from d join w using (doc_id)
""")
def note_documents(spark, sf_dir):
    """Documents as notes, every second one with front matter: title, aliases, tags, links and body."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    body = F.concat(F.lit("# "), "source", F.lit(" note\nSee [["), "source", F.lit("/n"), "doc_id", F.lit("#part|it]], [[pic.png]], [["), "lang", F.lit(" notes]] and #"), "lang", F.lit(".\n"), "text")
    head = F.concat(F.lit('---\ntitle: "'), "source", F.lit(": "), "doc_id", F.lit('"\ntags: ['), "source", F.lit(", lang-"), "lang", F.lit("]\naliases:\n  - d"), "doc_id", F.lit("\n---\n"))
    raw = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(head, body)).otherwise(body).alias("raw"))
    n = note_fields(raw, "raw", F.lit("notes/n.md"))
    return n.select("doc_id", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join(F.array_sort("tags"), ",").alias("tags"), F.array_join("links", ",").alias("links"), F.md5("body").alias("body_md5"))


_ISSUES = r"select event_id, 'fixes ' || upper(event_type) || '-' || json_extract_string(props, '$.k') || ' and ' || upper(event_type) || '-' || json_extract_string(props, '$.k') body, user_id from events"


def _issues(spark, sf_dir) -> DataFrame:
    key = F.concat_ws("-", F.upper("event_type"), F.get_json_object("props", "$.k"))
    return t(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("fixes "), key, F.lit(" and "), key).alias("body"))


@query(rf"""
select event_id, array_to_string(list_distinct(regexp_extract_all(body, '\b[A-Z][A-Za-z0-9]{{1,9}}-[0-9]{{1,6}}\b')), ',') keys from ({_ISSUES})
""")
def issue_keys(spark, sf_dir):
    return _issues(spark, sf_dir).select("event_id", F.array_join(text.issue_keys(F.col("body")), ",").alias("keys"))


_CLEAN = "regexp_replace(coalesce(\"text\", ''), '[^A-Za-z0-9 (){}\"\\n]', '', 'g')"
_CODE = rf"""
with d as (select doc_id, {_CLEAN} body, doc_id % 4 lang, doc_id % 7 other from documents),
f as (select *, length(body) - length(replace(body, chr(10), '')) n from d),
r as (
  select doc_id, 'symbol' what, 'function' kind, 'load_' || doc_id name, 'src::f' || doc_id || '::load_' || doc_id fqn, n + 2 start_line, n + 4 end_line, null target, 'pub fn load_' || doc_id || '(kg: u64) -> u64' signature, null confidence from f where lang = 0
  union all select doc_id, 'call', null, null, 'src::f' || doc_id || '::load_' || doc_id, n + 3, n + 3, 'weigh_' || other, null, 0.8 from f where lang = 0
  union all select doc_id, 'import', null, null, null, n + 5, n + 5, 'crate::f' || other, null, 1.0 from f where lang = 0
  union all select doc_id, 'symbol', 'class', 'Box' || doc_id, 'src::f' || doc_id || '::Box' || doc_id, n + 2, n + 6, null, 'class Box' || doc_id, null from f where lang = 1
  union all select doc_id, 'symbol', 'function', 'lift', 'src::f' || doc_id || '::Box' || doc_id || '::lift', n + 3, n + 5, null, 'lift(kg: number): number', null from f where lang = 1
  union all select doc_id, 'call', null, null, 'src::f' || doc_id || '::Box' || doc_id || '::lift', n + 4, n + 4, 'weigh_' || other, null, 0.8 from f where lang = 1
  union all select doc_id, 'import', null, null, null, n + 7, n + 7, './f' || other, null, 1.0 from f where lang = 1
  union all select doc_id, 'symbol', 'module', 'M' || doc_id, 'src::f' || doc_id || '::M' || doc_id, n + 4, n + 8, null, 'module M' || doc_id, null from f where lang = 2
  union all select doc_id, 'symbol', 'function', 'haul', 'src::f' || doc_id || '::M' || doc_id || '::haul', n + 5, n + 7, null, 'def haul(kg)', null from f where lang = 2
  union all select doc_id, 'call', null, null, 'src::f' || doc_id || '::M' || doc_id || '::haul', n + 6, n + 6, 'weigh_' || other, null, 0.8 from f where lang = 2
  union all select doc_id, 'import', null, null, null, n + 9, n + 9, 'f' || other, null, 1.0 from f where lang = 2
  union all select doc_id, 'symbol', 'class', 'Crate', 'src::f' || doc_id || '::Crate', n + 2, n + 4, null, 'class Crate:', null from f where lang = 3
  union all select doc_id, 'symbol', 'function', 'stow', 'src::f' || doc_id || '::Crate::stow', n + 3, n + 4, null, 'def stow(self):', null from f where lang = 3
  union all select doc_id, 'call', null, null, 'src::f' || doc_id || '::Crate::stow', n + 4, n + 4, 'weigh_' || other, null, 0.8 from f where lang = 3
  union all select doc_id, 'import', null, null, null, n + 5, n + 5, 'f' || other, null, 1.0 from f where lang = 3)
select doc_id, what, kind, name, fqn, cast(start_line as int) start_line, cast(end_line as int) end_line, target, signature, cast(confidence as double) confidence from r
"""


@query(_CODE)
def code_symbols(spark, sf_dir):
    """Documents as source files of four languages: the text in a comment or a literal, then declarations, a call and an import."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r'[^A-Za-z0-9 (){}"\n]', "").alias("body"))
    id_, other = F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string")
    rust = F.concat(F.lit("/*"), "body", F.lit("*/\npub fn load_"), id_, F.lit("(kg: u64) -> u64 {\n    weigh_"), other, F.lit('("} fn no() {", kg)\n}\nuse crate::f'), other, F.lit(";\n"))
    script = F.concat(F.lit("/*"), "body", F.lit("*/\nexport class Box"), id_, F.lit(" {\n  lift(kg: number): number {\n    return weigh_"), other, F.lit("(`}`);\n  }\n}\nimport { x } from './f"), other, F.lit("';\n"))
    ruby = F.concat(F.lit("=begin\n"), "body", F.lit("\n=end\nmodule M"), id_, F.lit("\n  def haul(kg)\n    weigh_"), other, F.lit("('end')\n  end\nend\nrequire 'f"), other, F.lit("'\n"))
    python = F.concat(F.lit("r'''"), "body", F.lit("'''\nclass Crate:\n    def stow(self):\n        return weigh_"), other, F.lit("('def')\nimport f"), other, F.lit("\n"))
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, rust).when(kind == 1, script).when(kind == 2, ruby).otherwise(python)
    ending = F.element_at(F.array(*map(F.lit, (".rs", ".ts", ".rb", ".py"))), (kind + 1).cast("int"))
    path = F.concat(F.lit("src/f"), id_, ending)
    files = d.select(id_.alias("id"), path.alias("path"), text.language(path).alias("language"), content.cast("binary").alias("content"))
    return code.symbols(files).select(F.col("id").cast("long").alias("doc_id"), "what", "kind", "name", "fqn", "start_line", "end_line", "target", "signature", "confidence")


@query(r"""
with recursive c as (select doc_id, "text" body, 0 k from documents union all select doc_id, body, k + 1 from c where k < 1),
h as (select doc_id, k, sha256(k || ':' || coalesce(body, '')) h from c),
u as (select doc_id, k * 8 + i nth, ('0x' || h[8 * i + 7:8 * i + 8] || h[8 * i + 5:8 * i + 6] || h[8 * i + 3:8 * i + 4] || h[8 * i + 1:8 * i + 2])::bigint / 2147483647.5 - 1 x from h, (select unnest(range(8)) i)),
n as (select doc_id, nth, x / sqrt(sum(x * x) over (partition by doc_id)) x from u)
select doc_id, cast(16 as bigint) dimension, round(sum(x * (nth + 1)), 4) weighted, round(max(x), 4) largest from n group by doc_id
""")
def hash_embeddings(spark, sf_dir):
    """Vectors of whole texts by the hashing embedder: a weighted sum and the largest of their components."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.col("doc_id").alias("parent"), "text")
    v = embed_chunks(d, HashEmbedder(16)).withColumnRenamed("embedding", "v")
    weighted = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(16)), lambda x, n: x * n), F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("v").cast("long").alias("dimension"), F.round(weighted, 4).alias("weighted"), F.round(F.array_max("v"), 4).alias("largest"))


_WIKI_PAGES = _HTML.rstrip().rsplit("select page_id, url,", 1)[0] + r"""
, b as (select page_id, regexp_replace(regexp_replace(regexp_replace(x, '^\n+', ''), '\n{3,}', chr(10) || chr(10), 'g'), '\n+\z', '') body from w)
select cast(page_id as varchar) path, 'Page ' || page_id title, page_id || ',Page ' || page_id || ',S' || (page_id % 3) || '/Page ' || page_id aliases, 'web,S' || (page_id % 3) tags,
  md5('# Page ' || page_id || chr(10) || chr(10) || '- space: `S' || (page_id % 3) || '`' || chr(10) || '- page_id: `' || page_id || '`' || chr(10) || '- url: https://wiki.example/wiki/p/' || page_id || chr(10) || '- labels: web' || chr(10) || chr(10)
    || case when body = '' then '' else body || chr(10) end) body_md5, cast(timestamp '2026-02-01 10:00:00' as timestamp) updated
from b
"""


@query(_WIKI_PAGES)
def wiki_pages(spark, sf_dir):
    """Web pages as the items of a recorded wiki export, to documents."""
    p, id_ = t(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    item = F.to_json(F.struct(
        F.col("page_id").alias("id"), F.concat(F.lit("Page "), id_).alias("title"), F.struct(F.concat(F.lit("S"), (F.col("page_id") % 3).cast("string")).alias("key")).alias("space"), F.struct(F.lit("2026-02-01T12:00:00+02:00").alias("when")).alias("version"),
        F.struct(F.concat(F.lit("/p/"), id_).alias("webui")).alias("_links"), F.struct(F.struct(F.array(F.struct(F.lit("web").alias("name"))).alias("results")).alias("labels")).alias("metadata"), F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body"),
    ))
    d = services.wiki_documents(p.select(item.alias("item")), "https://wiki.example/")
    return d.select("path", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags"), F.md5("body").alias("body_md5"), F.col("updated").cast("timestamp_ntz").alias("updated"))


@query(r"""
select 'EV-' || event_id path, 'EV-' || event_id || ' — ' || event_type title, event_type || ',Open,Task' tags, date_trunc('second', ts) updated,
  '# ' || event_type || chr(10) || chr(10) || '- key: `EV-' || event_id || '`' || chr(10) || '- type: Task' || chr(10) || '- status: Open' || chr(10) || case when user_id % 2 = 0 then '- priority: High' || chr(10) else '' end
    || '- url: https://issues.example/browse/EV-' || event_id || chr(10) || '- labels: ' || event_type || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || '## by ' || user_id || chr(10) || 'k is ' || json_extract_string(props, '$.k') || chr(10) body
from events
""")
def issue_documents(spark, sf_dir):
    """Events as the items of a recorded issue export, their descriptions as document trees."""
    e, id_ = t(spark, sf_dir, "events"), F.col("event_id").cast("string")
    run = lambda text_: F.array(F.struct(F.lit("text").alias("type"), text_.alias("text")))
    block = lambda kind, text_: F.struct(F.lit(kind).alias("type"), run(text_).alias("content"))
    tree = F.struct(F.lit("doc").alias("type"), F.array(block("heading", F.concat(F.lit("by "), F.col("user_id").cast("string"))), block("paragraph", F.concat(F.lit("k is "), F.get_json_object("props", "$.k")))).alias("content"))
    field = F.struct(
        F.col("event_type").alias("summary"), tree.alias("description"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+0000'").alias("updated"), F.array("event_type").alias("labels"), F.struct(F.lit("Open").alias("name")).alias("status"),
        F.struct(F.lit("Task").alias("name")).alias("issuetype"), F.when(F.col("user_id") % 2 == 0, F.struct(F.lit("High").alias("name"))).alias("priority"),
    )
    item = F.to_json(F.struct(F.concat(F.lit("EV-"), id_).alias("key"), field.alias("fields")))
    d = services.issue_documents(e.select(item.alias("item")), "https://issues.example")
    return d.select("path", "title", F.array_join("tags", ",").alias("tags"), F.col("updated").cast("timestamp_ntz").alias("updated"), "body")


# --- links -------------------------------------------------------------------------------------------

_LONG = "with s as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9_:]{2,}')) name, item_id from benchmark), c as (select name, 'benchmark::i' || lpad(cast(item_id as varchar), 6, '0') fqn from s where length(name) >= 7)"
_MENTIONS = _LONG + """, k as (select name, min(fqn) fqn from c group by name),
m as (select distinct doc_id, token, fqn from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_:]{2,}')) token from documents) join k on token = name)"""


def _catalog_of_items(spark, sf_dir) -> DataFrame:
    b = t(spark, sf_dir, "benchmark").select("item_id", F.explode(text.identifiers(F.col("text"))).alias("name")).distinct()
    return b.where(F.length("name") >= 7).select(F.lit("benchmark").alias("source"), "name", F.concat(F.lit("benchmark::i"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("fqn"))


def _mentions(spark, sf_dir) -> DataFrame:
    return link.mentions(t(spark, sf_dir, "documents").select("doc_id", "text"), _catalog_of_items(spark, sf_dir))


@query(_MENTIONS + " select doc_id, fqn, min(token) evidence, 0.9::double confidence from m group by doc_id, fqn")
def mention_link(spark, sf_dir):
    return _mentions(spark, sf_dir).select("doc_id", "fqn", "evidence", "confidence")


@query(_MENTIONS + ", e as (select doc_id, fqn from m group by doc_id, fqn) select fqn, count(*) n_docs, min(doc_id) first_doc from e group by fqn")
def mentions_by_symbol(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("fqn").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(_MENTIONS + " select doc_id, fqn, 0.9::double confidence, 'mentions:' || doc_id || ':' || fqn promoted_from from m group by doc_id, fqn")
def explains_promote(spark, sf_dir):
    return link.promote(_mentions(spark, sf_dir), 0.85).select("doc_id", "fqn", "confidence", "promoted_from")


@query("""
with e as (select doc_id, md5(case when toxic = 1 then text || '!' else text end) old from documents join labels using (doc_id)
           union all select 1000000000 + item_id, md5(text) from benchmark),
f as (select doc_id, md5(text) new from documents)
select coalesce(e.doc_id, f.doc_id) doc_id, case when new is null then 'removed' when old is null then 'added' when old <> new then 'changed' else 'skipped' end status
from e full join f on e.doc_id = f.doc_id
""")
def hash_diff(spark, sf_dir):
    """What an index of the labelled documents, the toxic ones edited since, would have to do."""
    d, l, b = (t(spark, sf_dir, n) for n in ("documents", "labels", "benchmark"))
    found = d.select("doc_id", F.md5("text").alias("hash"))
    old = d.join(l, "doc_id").select("doc_id", F.md5(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return link.changes(old.union(b.select(F.col("item_id") + 1000000000, F.md5("text"))), found, ["doc_id"])


_IMPORTS = """
with p as (select distinct regexp_replace(url, '^https?://', '') path from pages), w as (
  select page_id id, regexp_replace(url, '^https?://', '') base, 1 o from pages union all
  select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/[^/]*$', ''), 0 from pages),
e as (select unnest(['', '.ts', '.tsx', '.rs', '.py', '.rb', '/mod.rs', '/index.ts', '/index.tsx', '/__init__.py']) ending, generate_subscripts(['', '.ts', '.tsx', '.rs', '.py', '.rb', '/mod.rs', '/index.ts', '/index.tsx', '/__init__.py'], 1) k),
x as (select w.id, p.path, row_number() over (partition by w.id order by w.o, e.k, p.path) nth from w cross join e join p on p.path = w.base || e.ending)
select id, path from x where nth = 1
"""


@query(_IMPORTS)
def import_resolve(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    wanted = p.select(F.col("page_id").alias("id"), F.col("path").alias("base"), F.lit(1).alias("base_ord")).union(p.select("page_id", F.regexp_replace("path", "/[^/]*$", ""), F.lit(0)))
    return link.resolve_imports(wanted, p)


@query("""
with c as (select event_id call_id, event_type, user_id from events), s as (
  select event_type, user_id, min('e' || lpad(cast(event_id as varchar), 9, '0')) fqn from events group by event_type, user_id
), a as (select event_type, min(fqn) fqn from s group by event_type)
select c.call_id, coalesce(s.fqn, a.fqn) fqn from c left join s on s.event_type = c.event_type and s.user_id = c.user_id % 7 join a on a.event_type = c.event_type
""")
def call_resolve(spark, sf_dir):
    """Events as calls from the file user_id % 7; symbols are the events of each type and user."""
    e = t(spark, sf_dir, "events").select(F.lit("events").alias("source"), "event_id", F.col("event_type").alias("name"), F.col("user_id").alias("file"))
    symbols = e.select("source", "name", "file", F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("fqn"))
    return link.resolve_calls(e.select(F.col("event_id").alias("call_id"), "source", "name", (F.col("file") % 7).alias("file")), symbols)


_HREF = r"""select page_id id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) target from pages"""
_WIKI = rf"""
with l as (select distinct id, regexp_replace(target, '^https?://', '') target from ({_HREF})), d as (select distinct regexp_replace(url, '^https?://', '') path from pages),
k as (select path, array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/') key from (select path, unnest(range(1, len(string_split(path, '/')) + 1)) i from d)
  union all select path, array_to_string(list_slice(string_split(s, '/'), i, len(string_split(s, '/'))), '/') from (select path, s, unnest(range(1, len(string_split(s, '/')) + 1)) i from (select path, regexp_replace(path, '\.[^./]*$', '') s from d))),
h as (select l.id, l.target, min(path) path from l join k on k.key = l.target group by all)
"""


def _wikilinks(spark, sf_dir) -> DataFrame:
    p = t(spark, sf_dir, "pages")
    links = p.select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    links = links.select("id", F.lit("pages").alias("source"), F.regexp_replace("target", "^https?://", "").alias("target"))
    docs = p.select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct().withColumns({"source": F.lit("pages"), "title": F.lit(None).cast("string"), "aliases": F.array().cast("array<string>")})
    return link.resolve_wikilinks(links, docs).drop("source")


@query("""
with n as (select doc_id, source, source || '/n' || doc_id || '.md' path, 'Title ' || doc_id title, 'Also ' || doc_id alias from documents),
l as (select doc_id, source, unnest(['n' || (doc_id + 20), 'title ' || (doc_id + 40), 'ALSO ' || (doc_id + 60), 'n' || (doc_id + 1), source || '/n' || doc_id || '.md']) target from documents),
k as (select source, path, key, tier from (select source, path, unnest([path, replace(path, '.md', ''), 'n' || doc_id || '.md', 'n' || doc_id]) key, 1 tier from n) union all select source, path, lower(title), 2 from n union all select source, path, lower(alias), 3 from n)
select distinct l.doc_id id, l.target, (select arg_min(k.path, (k.tier, k.path)) from k where k.source = l.source and k.key = case when k.tier = 1 then l.target else lower(l.target) end) path from l
""")
def note_links(spark, sf_dir):
    """Documents as notes that link by path tail, by title and by alias in other case, to a note of another source, and to themselves."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    id_ = lambda k=0: (F.col("doc_id") + k).cast("string")
    path = F.concat("source", F.lit("/n"), id_(), F.lit(".md"))
    notes = d.select("source", path.alias("path"), F.concat(F.lit("Title "), id_()).alias("title"), F.array(F.concat(F.lit("Also "), id_())).alias("aliases"))
    targets = F.array(F.concat(F.lit("n"), id_(20)), F.concat(F.lit("title "), id_(40)), F.concat(F.lit("ALSO "), id_(60)), F.concat(F.lit("n"), id_(1)), path)
    return link.resolve_wikilinks(d.select(F.col("doc_id").alias("id"), "source", F.explode(targets).alias("target")), notes).select("id", "target", "path")


@query(_IMPORTS[: _IMPORTS.index("w as (")].replace("select distinct regexp_replace", "select distinct page_id, regexp_replace").rstrip(", \n") + """,
w as (select a.page_id id, regexp_replace(b.path, '/+$', '') base from p a join p b on b.page_id = a.page_id + 1 where len(string_split(regexp_replace(a.path, '/[^/]*$', ''), '/')) = 2),
e as (select unnest(['', '.ts', '.tsx', '.rs', '.py', '.rb', '/mod.rs', '/index.ts', '/index.tsx', '/__init__.py']) ending, generate_subscripts(['', '.ts', '.tsx', '.rs', '.py', '.rb', '/mod.rs', '/index.ts', '/index.tsx', '/__init__.py'], 1) k)
select w.id, arg_min(p.path, (e.k, p.path)) path from w cross join e join p on p.path = w.base || e.ending group by w.id
""")
def import_folded(spark, sf_dir):
    """Pages two folders deep that import the next page by way of `../..`."""
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("./../../"), "path").alias("target"))
    deep = F.size(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")) == 2
    wanted = import_bases(p.where(deep).join(after, "page_id").select(F.col("page_id").alias("id"), "path", "target"))
    return link.resolve_imports(wanted.where("base_ord = 0"), p)


@query(_WIKI + "select l.id, l.target, h.path from l left join h on h.id = l.id and h.target = l.target")
def wikilink_resolve(spark, sf_dir):
    return _wikilinks(spark, sf_dir)


@query(_WIKI + "select l.target, count(*) n from l left join h on h.id = l.id and h.target = l.target where h.path is null group by l.target")
def broken_links(spark, sf_dir):
    return _wikilinks(spark, sf_dir).where("path is null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
with k as (select event_id, user_id, unnest(list_distinct(regexp_extract_all(body, '\b[A-Z][A-Za-z0-9]{{1,9}}-[0-9]{{1,6}}\b'))) key from ({_ISSUES})),
tk as (select distinct 'VIEW-' || n_nationkey key, n_name ticket from nation union select distinct 'CLICK-' || n_nationkey, n_name from nation)
select distinct user_id, ticket from k join tk using (key)
""")
def resolves_link(spark, sf_dir):
    texts = _issues(spark, sf_dir).select(F.col("user_id").alias("file"), text.issue_keys(F.col("body")).alias("keys"))
    n = t(spark, sf_dir, "nation")
    tickets = n.select(F.explode(F.array(F.concat(F.lit("VIEW-"), "n_nationkey"), F.concat(F.lit("CLICK-"), "n_nationkey"))).alias("key"), F.col("n_name").alias("ticket"))
    symbols = texts.select("file", F.col("file").alias("fqn")).distinct()
    return link.resolve_issues(texts, tickets, symbols).select(F.col("fqn").alias("user_id"), "ticket")


# --- vectors -----------------------------------------------------------------------------------------

_KNN = """
with q as (select vec_id query_id, embedding q from embeddings where vec_id % 100 = 0), p as (
  select query_id, vec_id id, round(list_cosine_distance(embedding::double[], q::double[]), 5) distance, list_cosine_distance(embedding::double[], q::double[]) d, label from embeddings, q {where}),
k as (select *, row_number() over (partition by query_id order by round(d, 9), id) nth from p)
"""


def _knn(spark, sf_dir, vectors: DataFrame | None = None) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return search.nearest(e if vectors is None else vectors, e.where("vec_id % 100 = 0"))


@query(_KNN.format(where="") + "select query_id, id, distance, cast(nth as int) nth from k where nth <= 10")
def knn_exact(spark, sf_dir):
    return _knn(spark, sf_dir).select("query_id", "id", F.round("distance", 5).alias("distance"), "nth")


@query(_KNN.format(where="where label in (1, 3)") + "select query_id, id, round(1 / (1 + greatest(distance, 0)), 4) score, cast(nth as int) nth from k where nth <= 10")
def knn_filtered(spark, sf_dir):
    """Filtered before the search, so that k hits come back."""
    hits = _knn(spark, sf_dir, t(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3)))
    return hits.select("query_id", "id", F.round(search.distance_to_score(F.round("distance", 5)), 4).alias("score"), "nth")


@query(_CHUNKS + f", f as (select doc_id, count(*) n from c where contains(lower(chunk), '{NEEDLE}') group by doc_id), " + _KNN.format(where="").strip()[5:] + """,
v as (select query_id, id, 1 / (1 + greatest(round(d, 9), 0)) score from k where nth <= 10)
select v.query_id, v.id, round(0.6 * score + 0.1 * coalesce(f.n, 0), 5) total from v left join f on f.doc_id = v.id
""")
def hybrid_fusion(spark, sf_dir):
    v = _knn(spark, sf_dir).select("query_id", "id", search.distance_to_score(F.col("distance")).alias("score"))
    f = _chunks(spark, sf_dir).where(search.has(NEEDLE, "chunk")).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    lexical = v.select("query_id", "id").join(f, "id")
    return search.merge_channels(v, lexical, ["query_id", "id"]).select("query_id", "id", F.round("total", 5).alias("total"))


NEEDLES = ("the", "license", "and", "copyright")
_CASES = " union all ".join(f"select {i} as need, '{n}' as needle" for i, n in enumerate(NEEDLES))


_SEMANTIC = _CHUNKS + f", nd as ({_CASES}), " + _KNN.format(where="").strip()[5:] + """,
ci as (select distinct 'benchmark::i' || lpad(cast(item_id as varchar), 6, '0') fqn, unnest(regexp_extract_all(text, '[A-Za-z0-9_:]{2,}')) name from benchmark),
ca as (select fqn, name from ci where length(name) >= 7), mk as (select name, min(fqn) fqn from ca group by name),
m as (select distinct doc_id, fqn from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_:]{2,}')) token from documents) join mk on token = name),
f as (select need, doc_id, count(*) n from c join nd on contains(lower(chunk), needle) group by all),
lx as (select need, 'document:' || doc_id parent, 'chunk' channel, n "value", row_number() over (partition by need order by n desc, doc_id) nth from f
  union all select need, 'document:' || doc_id, 'document', 1, row_number() over (partition by need order by doc_id) from documents join nd on contains(lower("text"), needle)
  union all select need, 'symbol:' || fqn, 'symbol', 1, row_number() over (partition by need order by strlen(fqn), fqn) from (select distinct need, cs.fqn from ca cs join nd on contains(lower(cs.fqn), needle) or contains(lower(cs.name), needle))),
al as (select query_id, 'document:' || id parent, 'vector' channel, 1 / (1 + greatest(round(d, 9), 0)) "value" from k where nth <= 10
  union all select e.vec_id, lx.parent, lx.channel, lx."value" from embeddings e join lx on lx.need = e.label % 4 where e.vec_id % 100 = 0 and lx.nth <= 10),
fu as (select query_id, parent, max(case when channel = 'vector' then "value" end) vector, sum(case when channel = 'chunk' then "value" end) chunk, sum(case when channel = 'symbol' then "value" end) symbol, sum(case when channel = 'document' then "value" end) document from al group by query_id, parent),
sc as (select *, 0.6 * coalesce(vector, 0) + 0.1 * (coalesce(chunk, 0) + coalesce(symbol, 0) + coalesce(document, 0)) score from fu),
li as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, parent) nth from sc) where nth <= 15),
ed as (select 'document:' || doc_id src, 'symbol:' || fqn dst from m),
bo as (select src node, dst other, 'out' direction from ed union all select dst, src, 'in' from ed),
ro as (select distinct parent root from li where nth <= 3),
ne as (select * from (select bo.*, row_number() over (partition by node order by direction, other) pl, count(*) over (partition by node) cn from bo join ro on ro.root = bo.node) where pl <= 25),
nn as (select node, other, pl, 0.3 / (1 + least(1 + least(cn, 25), 15)) lift, cn >= 15 cut from ne where pl <= 15),
ol as (select li.query_id, nn.* from li join nn on nn.node = li.parent where li.nth <= 3),
fi as (select query_id, node, pl, lift, arg_min(parent, nth) parent from (select ol.*, li.parent, li.nth from ol join li on li.query_id = ol.query_id and li.parent in (ol.node, ol.other)) group by query_id, node, pl, lift),
lf as (select query_id, parent, sum(lift) lift from fi group by query_id, parent),
re as (select li.query_id, li.parent, vector, chunk, symbol, document, nth, coalesce(lift, 0) lift, score + coalesce(lift, 0) score,
  coalesce((select bool_or(cut) from ol where ol.query_id = li.query_id), false) or count(*) over (partition by li.query_id) >= 15 truncated from li left join lf on lf.query_id = li.query_id and lf.parent = li.parent)
select query_id, parent, round(vector, 5) vector, cast(chunk as double) chunk, cast(symbol as double) symbol, cast(document as double) document, round(lift, 6) lift, round(score, 5) score, truncated,
  cast(row_number() over (partition by query_id order by round(score, 9) desc, nth) as int) "rank" from re
"""


@query(_SEMANTIC)
def semantic_search(spark, sf_dir):
    """Each query's list over vectors, chunks, symbols and documents, lifted by the graph of mentions.

    A query's label names the needle of its lexical channels, of which each gives its first ten.
    """
    q = t(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % 4).alias("need"))
    needs = lambda *columns: F.explode(F.filter(F.array(*(F.when(search.has(n, *columns), F.lit(i)) for i, n in enumerate(NEEDLES))), lambda x: x.isNotNull())).alias("need")
    doc, symbol = F.concat(F.lit("document:"), F.col("doc_id").cast("string")), F.concat(F.lit("symbol:"), "fqn")
    chunk = _chunks(spark, sf_dir).select("doc_id", needs("chunk")).groupBy("need", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = lambda found, order: q.join(search.first_per_source(found, order, 10, "need").drop("nth"), "need")
    chunk = search.hits(top(chunk, [F.col("n").desc(), F.col("doc_id")]), "chunk", doc, F.col("n"))
    document = search.hits(top(t(spark, sf_dir, "documents").select("doc_id", needs("text")), [F.col("doc_id")]), "document", doc)
    named = _catalog_of_items(spark, sf_dir).select("fqn", needs("fqn", "name")).distinct()
    named = search.hits(top(named, [F.octet_length("fqn"), F.col("fqn")]), "symbol", symbol)
    vector = search.hits(_knn(spark, sf_dir).withColumnRenamed("id", "doc_id"), "vector", doc, search.distance_to_score(F.col("distance")))
    mentions = written(_mentions(spark, sf_dir).select(F.lit("mentions").alias("relation"), doc.alias("src"), symbol.alias("dst")), "mentions")
    lists = written(search.fused(vector.unionByName(chunk).unionByName(document).unionByName(named), 15), "lists")
    out = search.lifted(lists, mentions, limit=15)
    return out.select("query_id", "parent", F.round("vector", 5).alias("vector"), "chunk", "symbol", "document", F.round("lift", 6).alias("lift"), F.round("score", 5).alias("score"), "truncated", "rank")


# --- graph -------------------------------------------------------------------------------------------

_EDGES = """
e as (select 'in_region' relation, 'n' || n_nationkey src, 'r' || n_regionkey dst from nation union all
select 'customer_of', 'c' || c_custkey, 'n' || c_nationkey from customer union all
select 'supplier_of', 's' || s_suppkey, 'n' || s_nationkey from supplier union all
select 'placed_by', 'o' || o_orderkey, 'c' || o_custkey from orders)
"""
_BOTH = ", b as (select src node, dst other, relation, 'out' direction from e union all select dst, src, relation, 'in' from e)"


def edges(spark, sf_dir) -> DataFrame:
    """The star schema as a property graph."""
    id_ = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("in_region", "nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer_of", "customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier_of", "supplier", "s", "s_suppkey", "n", "s_nationkey"), ("placed_by", "orders", "o", "o_orderkey", "c", "o_custkey")]
    out = None
    for relation, name, a, src, b, dst in parts:
        e = t(spark, sf_dir, name).select(F.lit(relation).alias("relation"), id_(a, src).alias("src"), id_(b, dst).alias("dst"))
        out = e if out is None else out.union(e)
    return out


def _nations(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))


@query("with " + _EDGES + _BOTH + """, k as (select b.*, row_number() over (partition by node, relation order by direction, other) nth from b where node in (select 'n' || n_nationkey from nation))
select node, other, relation, direction from k where nth <= 25
""")
def neighbors(spark, sf_dir):
    return graph.neighbors(edges(spark, sf_dir), _nations(spark, sf_dir)).select("node", "other", "relation", "direction")


_BFS = "with " + _EDGES + _BOTH + """, l0 as (select 'n' || n_nationkey root from nation), l1 as (select distinct root, other node from l0 join b on b.node = root),
l2 as (select distinct root, b.other node from l1 join b on b.node = l1.node), s as (
select root, root node, 0 level from l0 union all select root, node, 1 from l1 where node <> root union all
select root, node, 2 from l2 where node <> root and not exists (select 1 from l1 where l1.root = l2.root and l1.node = l2.node)),
k as (select *, row_number() over (partition by root order by level, node) nth, count(*) over (partition by root) > 40 truncated from s)
"""


@query(_BFS + "select root, node, level, truncated from k where nth <= 40")
def bfs_depth2(spark, sf_dir):
    return graph.neighborhood(edges(spark, sf_dir), _nations(spark, sf_dir)).select("root", "node", "level", "truncated")


@query(_BFS + """, n as (select root, node, truncated from k where nth <= 40)
select distinct a.root, e.relation, e.src, e.dst, a.truncated from e join n a on a.node = e.src join n c on c.root = a.root and c.node = e.dst
""")
def neighborhood_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.edges_within(e, graph.neighborhood(e, _nations(spark, sf_dir)))


_NODES = """select 'r' || r_regionkey id, 'region' kind, r_name label from region union all select 'n' || n_nationkey, 'nation', n_name from nation
union all select 'c' || c_custkey, 'customer', c_name from customer union all select 's' || s_suppkey, 'supplier', s_name from supplier"""


def nodes(spark, sf_dir) -> DataFrame:
    out = None
    for kind, p, key, name in (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name")):
        n = t(spark, sf_dir, kind).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("title"), F.col(name).alias("name"), F.col(key).cast("string").alias("key"))
        out = n if out is None else out.union(n)
    return out


@query("with " + _EDGES + f", x as ({_NODES}) select id, kind, label from x where id in (select dst from e)")
def describe_nodes(spark, sf_dir):
    return graph.describe(nodes(spark, sf_dir), edges(spark, sf_dir).select(F.col("dst").alias("id")))


@query("with " + _EDGES + f", x as ({_NODES}) select relation, count(*) n from e where src in (select id from x) and dst in (select id from x) group by relation")
def edges_with_endpoints(spark, sf_dir):
    return link.with_endpoints(edges(spark, sf_dir), nodes(spark, sf_dir)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("with " + _EDGES + ", g as (select 'c' || c_custkey id from customer where c_acctbal < 0) select relation, count(*) n from e where src not in (select id from g) and dst not in (select id from g) group by relation")
def cascade_delete(spark, sf_dir):
    gone = t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return graph.cascade_delete(nodes(spark, sf_dir), edges(spark, sf_dir), gone)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("with " + _EDGES + f""", s as (select 'n' || n_nationkey parent, 1.0 / (1 + n_nationkey) score, row_number() over (order by n_nationkey) nth from nation),
top as (select parent root from s where nth <= 3), r as (select src root, src, dst from e union all select dst, src, dst from e),
near as (select r.* from r join top using (root)), m as (select root, count(distinct n) nodes from (select root, src n from near union all select root, dst from near) group by root),
l as (select near.*, 0.3 / (1 + nodes) lift, row_number() over () edge from near join m using (root)),
f as (select edge, lift, arg_min(s.parent, s.nth) parent from (select edge, lift, src p from l union select edge, lift, dst from l) y join s on s.parent = y.p group by edge, lift)
select s.parent, round(score + coalesce((select sum(lift) from f where f.parent = s.parent), 0), 6) boosted from s
""")
def graph_boost(spark, sf_dir):
    hits = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent"), (1.0 / (1 + F.col("n_nationkey"))).alias("score"), F.row_number().over(W.orderBy("n_nationkey")).alias("nth"))
    return search.graph_boost(hits, edges(spark, sf_dir)).select("parent", F.round("boosted", 6).alias("boosted"))


@query("with " + _EDGES + _BOTH + f""", x as ({_NODES}), d as (select 'n' || n_nationkey root from nation where contains(lower(n_name), 'a') order by n_name limit 3),
c as (select 'c' || c_custkey root from customer where contains(lower(c_name), '1') order by c_name, c_custkey limit 3), roots as (select * from d union all select * from c),
k as (select b.*, row_number() over (partition by node, relation order by direction, other) nth from b where node in (select root from roots))
select k.node, k.other, k.relation, k.direction, x.label from k left join x on x.id = k.other where nth <= 25
""")
def context_bundle(spark, sf_dir):
    """Top three hits of two channels, their neighbourhoods in one join, labels of the other ends."""
    n, c = t(spark, sf_dir, "nation"), t(spark, sf_dir, "customer")
    top = n.where(search.has("a", "n_name")).orderBy("n_name").limit(3).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    more = c.where(search.has("1", "c_name")).orderBy("c_name", "c_custkey").limit(3).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    near = graph.neighbors(edges(spark, sf_dir), top.union(more))
    labels = nodes(spark, sf_dir).select(F.col("id").alias("other"), F.col("name").alias("label"))
    return near.join(labels, "other", "left").select("node", "other", "relation", "direction", "label")


LETTERS = ("a", "i", "9")
_LETTER_CASES = " union all ".join(f"select '{x}' as letter" for x in LETTERS)


@query("with " + _EDGES + _BOTH + f""", x as ({_NODES}), q as ({_LETTER_CASES}),
s as (select letter, 'c' || c_custkey id, row_number() over (partition by letter order by strlen(c_name), c_name, c_custkey) nth from customer join q on contains(lower(c_name), letter)),
d as (select letter, 'n' || n_nationkey id, row_number() over (partition by letter order by n_name) nth from nation join q on contains(lower(n_name), letter)),
f as (select letter, id, 'symbol' section, nth from s where nth <= 20 union all select letter, id, 'document', nth from d where nth <= 20),
top as (select distinct letter, id root from f where nth <= 3),
r as (select *, row_number() over (partition by node, relation order by direction, other) nth from b where node in (select root from top)),
o as (select *, row_number() over (partition by node order by relation, nth) pos from r where nth <= 25),
p as (select *, row_number() over (partition by node order by pos) place from o where pos <= 25),
re as (select top.letter, root, other id, relation, direction, place from top join p on p.node = root where place <= 20),
t as (select letter, max(c) truncated from (select letter, count(*) >= 20 c from f group by letter, section union all select letter, place >= 20 from re) group by letter)
select y.letter query_id, section, root, y.id, relation, direction, label, truncated, 'tables' source_filter from (
  select letter, section, null root, id, null relation, null direction from f union all select letter, 'related', root, id, relation, direction from re where place < 20) y
  left join x on x.id = y.id join t on t.letter = y.letter
""")
def explore_context(spark, sf_dir):
    """Bundles for three needles: customers as symbols, nations as documents, the graph around the first three of each."""
    n, c = t(spark, sf_dir, "nation"), t(spark, sf_dir, "customer")
    held = lambda column: F.explode(F.filter(F.array(*(F.when(search.has(x, column), F.lit(x)) for x in LETTERS)), lambda x: x.isNotNull())).alias("query_id")
    ask = F.lit("tables").alias("source_filter")
    symbols = c.select(held("c_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_name", "c_custkey", ask)
    symbols = search.first_per_source(symbols, [F.octet_length("c_name"), F.col("c_name"), F.col("c_custkey")], 20, "query_id")
    documents = search.first_per_source(n.select(held("n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_name", ask), [F.col("n_name")], 20, "query_id")
    return search.explored(symbols, documents, edges(spark, sf_dir), nodes(spark, sf_dir), 20)


# --- the index job ------------------------------------------------------------------------------------

_PAGES = r"""
with i as (select distinct upper(event_type) || '-' || json_extract_string(props, '$.k') key from events),
p as (select distinct doc_id, "text" || chr(10) || 'see ' || upper(e.event_type) || '-' || (doc_id % 120) body from documents, (select min(event_type) event_type from events) e),
k as (select doc_id, unnest(list_distinct(regexp_extract_all(body, '\b[A-Z][A-Za-z0-9]{1,9}-[0-9]{1,6}\b'))) key from p)
select 'contains' relation, 'source:pages' src, 'document:pages:' || doc_id dst from p union all select 'contains', 'source:board', 'document:board:' || key from i
union all select distinct 'references', 'document:pages:' || doc_id, 'document:board:' || key from k join i using (key)
"""


@query(_PAGES)
def index_pages(spark, sf_dir):
    """Edges after three runs of the index job: every second document as a wiki page, then the issues of the events, then all documents.

    The second run links pages of the first, the third writes the partitions of what is new.
    """
    d = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", "text")
    e = t(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    kind = e.agg(F.upper(F.min("event_type")).alias("kind"))
    body = F.concat("text", F.lit("\nsee "), "kind", F.lit("-"), (F.col("doc_id") % 120).cast("string"))
    id_, none, now = F.col("doc_id").cast("string"), F.array().cast("array<string>"), F.lit("2026-01-01").cast("timestamp")
    pages = d.join(F.broadcast(kind), how="cross").select(id_.alias("path"), F.concat(F.lit("Page "), id_).alias("title"), none.alias("aliases"), F.array("source").alias("tags"), body.alias("body"), F.sha2("text", 256).alias("hash"), now.alias("updated"))  # one row
    key = F.concat_ws("-", F.upper("event_type"), "k")
    issues = e.select(key.alias("path")).distinct().select("path", F.col("path").alias("title"), F.array("path").alias("aliases"), none.alias("tags"), F.lit("").alias("body"), F.sha2("path", 256).alias("hash"), now.alias("updated"))
    store = Store(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", 16)
    runs = [(Source("pages", "wiki", ""), pages.where("cast(path as long) % 2 = 0")), (Source("board", "issues", ""), issues), (Source("pages", "wiki", ""), pages)]
    for source, docs in runs:
        index(spark, store, [source], given={source.name: docs})
    return store.read("edge").select("relation", "src", "dst")


def _stored(spark, sf_dir) -> Store:
    """A new store that holds the documents by their sources, the parts as symbols by their brands, and one source with nothing."""
    store = Store(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", 8)
    d = t(spark, sf_dir, "documents").where("source is not null").select("source", F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.md5("text").alias("hash"))
    p = catalog(spark, sf_dir).select("source", F.concat(F.lit("p"), F.col("key").cast("string")).alias("path"), "name", "fqn")
    known = d.select("source", F.lit("notes").alias("kind")).union(p.select("source", F.lit("code"))).distinct().union(spark.range(1).select(F.lit("empty"), F.lit("notes")))
    store.put("source", known.select(F.lit("source").alias("source"), F.col("source").alias("path"), "kind"))
    store.put("document", d)
    store.put("symbol", p)
    store.put("file", d.select("source", "path", "hash", F.lit("notes").alias("kind")).unionByName(p.select("source", "path", F.lit("code").alias("kind")).distinct(), allowMissingColumns=True))
    return store


@query("""
with d as (select source, count(*) n from documents where source is not null group by source), p as (select p_brand source, count(*) n, count(distinct p_partkey) files from part group by p_brand)
select source name, 'notes' kind, cast(0 as bigint) files, cast(0 as bigint) symbols, n documents from d union all select source, 'code', files, n, cast(0 as bigint) from p union all select 'empty', 'notes', 0, 0, 0
""")
def source_counts(spark, sf_dir):
    """Every source of a store with its numbers, zeros kept."""
    return Graph(_stored(spark, sf_dir)).list_sources().select("name", "kind", "files", "symbols", "documents")


@query("""
with a as (select distinct 'Item ' || item_id title, unnest([item_id * 3, item_id * 3 + 1, -1]) doc_id from benchmark)
select distinct 'about' relation, 'decision:system:' || a.title src, 'document:' || d.source || ':' || d.doc_id dst from a join documents d using (doc_id) where d.source is not null
""")
def decision_edges(spark, sf_dir):
    """Benchmark items as decisions about two documents each and one that isn't there, written twice: what they are about."""
    store = _stored(spark, sf_dir)
    b = t(spark, sf_dir, "benchmark").select("item_id", "text")
    sources = t(spark, sf_dir, "documents").select("doc_id", "source")
    wanted = b.select("item_id", F.explode(F.array(F.col("item_id") * 3, F.col("item_id") * 3 + 1, F.lit(-1).cast("long"))).alias("doc_id")).join(sources, "doc_id", "left")
    tokens = wanted.groupBy("item_id").agg(F.collect_set(F.concat_ws(":", F.lit("Document"), F.coalesce("source", F.lit("gone")), F.col("doc_id").cast("string"))).alias("about"))
    made = b.join(tokens, "item_id").select(F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), F.concat(F.lit("about "), "text").alias("body"), "about")
    for rows in (made.where("substring(title, -1) < '5'"), made):
        add_decisions(store, rows)
    return store.read("edge").select("relation", "src", "dst")


# --- increments --------------------------------------------------------------------------------------

@query("""
with f as (select * from events where ts >= date_trunc('minute', (select min(ts) + interval 10 day from events)))
select event_type, count(*) n, max(ts) high_water, (select max(ts) from f) next_cursor from f group by event_type
""")
def cursor_increment(spark, sf_dir):
    """Events as issues, from a cursor ten days after the first: what an incremental run reads, and the cursor that it leaves."""
    e = t(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("updated"))
    cursor = e.agg(F.date_format(F.min("updated") + F.expr("interval 10 days"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first()["m"]
    found = services.updated_since(e, cursor or "1970-01-01 00:00:00")
    after = services.high_water(found).select(F.col("updated").cast("timestamp_ntz").alias("next_cursor"))
    by_type = found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("updated").cast("timestamp_ntz").alias("high_water"))
    return by_type.join(F.broadcast(after), how="cross")  # one row


@query("""
select date_trunc('hour', ts) batch, event_type source, count(distinct user_id) paths from events group by all
""")
def coalesce_jobs(spark, sf_dir):
    """Change events to one job for each batch and source, paths counted once."""
    e = t(spark, sf_dir, "events").select(F.struct(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("batch"), F.col("event_type").alias("source")).alias("source"), F.col("user_id").alias("path"))
    return watch.coalesce(e).groupBy("source.batch", "source.source").agg(F.count(F.lit(1)).alias("paths"))


@query("""
with x as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn, text) before from conversations)
select conv_id, count(*) turns, cast(sum(case when before is distinct from role then 1 else 0 end) as bigint) changes, cast(sum(length(text)) as bigint) n_chars from x group by conv_id
""")
def conversation_threads(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn", "text"))
    c = c.select("conv_id", F.length("text").alias("n"), F.when(before.eqNullSafe(F.col("role")), 0).otherwise(1).alias("change"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("change").alias("changes"), F.sum("n").alias("n_chars"))
