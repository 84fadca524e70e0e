"""Linkers as joins: change detection, imports, calls, wikilinks, mentions, issue references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import identifiers

#: Confidence of a mention by full name and by short name.
FULL, SHORT = 1.0, 0.9
#: Endings that an import may leave out.
SUFFIXES = ("", ".ts", ".tsx", ".rs", ".py", ".rb", "/mod.rs", "/index.ts", "/index.tsx", "/__init__.py")


def changes(existing: DataFrame, found: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """existing, found(keys, hash) -> keys, status: added, changed, skipped or removed."""
    e, f = existing.select(*keys, F.col("hash").alias("old")), found.select(*keys, F.col("hash").alias("new"))
    status = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.lit(force) | (F.col("old") != F.col("new")), "changed").otherwise("skipped")
    return e.join(f, keys, "full_outer").select(*keys, status.alias("status"))


def resolve_imports(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """wanted(id, base, base_ord), paths(path) -> id, path: the first base and ending that exists."""
    ends = F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("end_ord", "end")
    tried = wanted.select("id", "base", "base_ord", ends).withColumn("path", F.concat("base", "end"))
    return tried.join(paths.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", F.struct("base_ord", "end_ord", "path")).alias("path"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls(call_id, source, name, file), symbols(source, name, file, fqn) -> call_id, fqn: same file first, then least fqn.

    Both tiers are aggregated before the join, so a name that thousands of symbols share is one row.
    """
    near = symbols.groupBy("source", "name", "file").agg(F.min("fqn").alias("_near"))
    any_ = near.groupBy("source", "name").agg(F.min("_near").alias("_any"))
    found = calls.join(near, ["source", "name", "file"], "left").join(any_, ["source", "name"])
    return found.select("call_id", F.coalesce("_near", "_any").alias("fqn"))


def link_targets(docs: DataFrame) -> DataFrame:
    """docs(source, path, title, aliases) -> source, key, tier, path: every name a wikilink can have for a note."""
    full, short = F.split("path", "/"), F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    tails = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))
    by_path = docs.select(F.explode(F.array_distinct(F.concat(tails(full), tails(short)))).alias("key"), F.lit(1).alias("tier"), "path", "source")
    by_title = docs.select(F.lower("title").alias("key"), F.lit(2).alias("tier"), "path", "source")
    by_alias = docs.select(F.explode(F.transform("aliases", F.lower)).alias("key"), F.lit(3).alias("tier"), "path", "source")
    return by_path.union(by_title).union(by_alias)


def resolve_wikilinks(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links(id, source, target) -> id, source, target, path (null if broken) within the source: path or stem, then title, then alias.

    A note ends with the target exactly if the target is one of the note's path tails, so the suffix
    match is an equality; the title and alias tiers compare in lower case.
    """
    t = link_targets(docs).groupBy("source", "tier", "key").agg(F.min("path").alias("path"))
    keyed = links.select("id", "source", "target", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("target").alias("key")), *(F.struct(F.lit(k).alias("tier"), F.lower("target").alias("key")) for k in (2, 3)))).alias("x")).select("id", "source", "target", "x.*")
    found = keyed.join(t, ["source", "tier", "key"]).groupBy("id", "source", "target").agg(F.min_by("path", F.struct("tier", "path")).alias("path"))
    return links.select("id", "source", "target").distinct().join(found, ["id", "source", "target"], "left")


def mentions(docs: DataFrame, catalog: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs(doc_id, text), catalog(source, name, fqn) -> doc_id, source, fqn, confidence, evidence.

    Tokens are made distinct per document before the join; the smallest evidence stays.
    """
    tokens = docs.select("doc_id", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("token"))
    full = catalog.select(F.col("fqn").alias("token"), "source", "fqn", F.lit(FULL).alias("confidence"), F.lit(0).alias("by"))
    short = catalog.where(F.length("name") >= 2).groupBy(F.col("name").alias("token")).agg(F.min_by("source", F.struct("fqn", "source")).alias("source"), F.min("fqn").alias("fqn")).select("token", "source", "fqn", F.lit(SHORT).alias("confidence"), F.lit(1).alias("by"))
    names = full.union(short).where(F.col("confidence") >= threshold).groupBy("token").agg(F.min_by(F.struct("source", "fqn", "confidence"), F.struct("by", "fqn", "source")).alias("hit"))
    hits = tokens.join(names, "token").select("doc_id", "token", "hit.*")
    return hits.groupBy("doc_id", "source", "fqn").agg(F.min("token").alias("evidence"), F.min_by("confidence", "token").alias("confidence"), F.max("confidence").alias("max_confidence"))


def promote(mentioned: DataFrame, threshold: float) -> DataFrame:
    """Mentions that are sure enough become explanations, their confidence and origin kept."""
    return mentioned.where(F.col("confidence") >= threshold).select("doc_id", "source", "fqn", "confidence", F.concat_ws(":", F.lit("mentions"), F.col("doc_id").cast("string"), "fqn").alias("promoted_from"))


def resolve_issues(texts: DataFrame, tickets: DataFrame, symbols: DataFrame) -> DataFrame:
    """texts(file, keys), tickets(key, ticket), symbols(file, fqn) -> distinct (fqn, ticket)."""
    keyed = texts.select("file", F.explode(F.array_distinct("keys")).alias("key"))
    return keyed.join(tickets, "key").join(symbols, "file").select("fqn", "ticket").distinct()


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def missing(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Edges to insert: those that aren't there yet."""
    return new.dropDuplicates(keys).join(existing, keys, "left_anti")


