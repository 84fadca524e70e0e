"""Index job: scan, diff by hash, extract what changed, link anew what that can change, write the partitions touched.

Edges belong to the file they come from. A run links the files that changed and those whose candidates name
something that appeared or went (a symbol, a path, a note, an issue), so that a chain of small runs and one
full run hold the same edges. The table of files is written last: what a broken run has done is done again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import code, text
from loomgraph.functions.embed import Embedder, NoEmbedder, embed_chunks
from loomgraph.operators import link
from loomgraph.operators.store import KEYS, Store
from loomgraph.sources import services
from loomgraph.sources.connectors import CONNECTORS, Source, documents, note_fields

__all__ = ["Settings", "Source", "index"]

EDGE = ["relation", "src", "dst"]
COUNTERS = ("discovered", "indexed", "skipped", "removed", "symbols", "imports", "calls", "documents", "references", "mentions", "explains", "resolves", "broken_links", "chunks")
PAGES = ("wiki", "workspace")


@dataclass(frozen=True)
class Settings:
    mention_threshold: float = 0.75
    promote_from: float | None = None
    force: bool = False
    embedder: Embedder = field(default_factory=NoEmbedder)


class Report:
    """Counters by source, zeros kept, taken on the way of the job's own writes."""

    def __init__(self, names: list[str]):
        self.names, self.counts, self._open = names, {n: dict.fromkeys(COUNTERS, 0) for n in names}, []

    def watch(self, rows: DataFrame, counters: dict[str, F.Column]) -> DataFrame:
        """rows, counted by source as they are written: counter -> condition."""
        seen = Observation()
        cells = {f"c{i}": (n, c, F.count_if((F.col("source") == n) & test)) for i, (n, (c, test)) in enumerate((n, x) for n in self.names for x in counters.items())}
        self._open.append((seen, cells))
        return rows.observe(seen, *(e.alias(k) for k, (_, _, e) in cells.items()))

    def close(self, partitions: int) -> None:
        """Reads what the last write has counted, if it wrote any partition."""
        for seen, cells in self._open if partitions else ():
            for k, v in seen.get.items():
                n, c, _ = cells[k]
                self.counts[n][c] += v
        self._open = []


def import_bases(candidates: DataFrame) -> DataFrame:
    """(id, path, target) -> (id, base, base_ord): where an import can point, first choice first; `.` and `..` are folded."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    beside = lambda x: F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), x)
    dotted = F.regexp_replace(F.regexp_replace("target", r"^\.+", ""), r"\.", "/")
    ups = F.repeat(F.lit("../"), F.greatest(F.length(F.regexp_extract("target", r"^(\.+)[^/]*$", 1)) - 1, F.lit(0)))
    crate = F.regexp_replace(F.regexp_replace("target", "^(crate|self|super)::", ""), "::", "/")
    choices = F.array(beside(F.col("target")), F.concat(F.lit("src/"), crate), F.concat(F.lit("src/"), F.regexp_replace(crate, "/[^/]*$", "")), beside(F.concat(ups, dotted)), dotted, F.col("target"))
    return candidates.select("id", F.posexplode(choices).alias("base_ord", "base")).withColumn("base", text.folded(F.col("base"))).where("base is not null and base <> ''")


def index(spark: SparkSession, store: Store, sources: list[Source], settings: Settings = Settings(), only: DataFrame | None = None, given: dict[str, DataFrame] | None = None) -> dict[str, dict[str, int]]:
    """Brings the store up to date with its sources; returns all counters by source.

    given: documents of sources that were read elsewhere (a stream), a delta that removes nothing.
    only(source, path): looks at those paths alone (a batch of changes); others are neither read nor removed.
    Issues are read since the cursor that the last run has left, and such a run removes none; a forced run reads
    all, and drops the cursor if nothing is there. With an embedder and no chunk in the store the run is forced.
    """
    if not sources:
        raise ValueError("no source is configured")
    names = [s.name for s in sources]
    unknown = sorted({s.kind for s in sources} - set(CONNECTORS))
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"unknown kinds of sources {unknown} or equal names in {names}")
    store.migrate()
    force = settings.force
    if settings.embedder.enabled:
        force = force or store.read("chunk").limit(1).count() == 0
        store.write_meta(embedding_kind=settings.embedder.kind, embedding_model=settings.embedder.model, embedding_dimension=str(settings.embedder.dimension))
    cursors = {s.name: None if force or only is not None else store.meta(f"issues.{s.name}.updated") for s in sources if CONNECTORS[s.kind].delta}
    report = Report(names)

    def items(s: Source) -> DataFrame:
        if given and s.name in given:
            return CONNECTORS[s.kind].shaped(documents(given[s.name]), s)
        own = None if only is None else only.where(F.col("source") == s.name).select(text.folded(F.col("path")).alias("id")).where("id is not null and id <> ''")
        return CONNECTORS[s.kind].items(spark, s, own, cursors.get(s.name))

    found = items(sources[0])
    for s in sources[1:]:
        found = found.unionByName(items(s))
    known = store.read("file").where(F.col("source").isin(names)).select(*KEYS, "hash")
    if only is not None:
        known = known.join(only.select("source", text.folded(F.col("path")).alias("path")).distinct(), KEYS, "left_semi")
    kept = [n for n, c in cursors.items() if c] + list(given or ())  # a delta removes nothing
    status = link.changes(known, found.select(*KEYS, "hash"), KEYS, force).where(~((F.col("status") == "removed") & F.col("source").isin(kept)))
    status = store.staged(status)
    shown = {r.source: r.asDict() for r in status.groupBy("source").pivot("status", ["added", "changed", "skipped", "removed"]).count().na.fill(0).collect()}
    for n, r in shown.items():
        report.counts[n].update(discovered=r["added"] + r["changed"] + r["skipped"], indexed=r["added"] + r["changed"], skipped=r["skipped"], removed=r["removed"])
    if any(r["added"] + r["changed"] + r["removed"] for r in shown.values()):
        kinds = {r.path: r.kind for r in store.read("source").select("path", "kind").collect()} | {s.name: s.kind for s in sources}
        _apply(store, report, status, found, settings, kinds)
    for s in sources:
        if s.name in cursors and only is None:
            _move_cursor(store, s.name, found.where(F.col("source") == s.name), force)
    store.upsert("source", spark.createDataFrame([(s.name, "", s.kind, s.root, s.url or None) for s in sources], "path string, source string, kind string, root_path string, remote_url string").withColumn("source", F.lit("source")).withColumn("last_indexed", F.current_timestamp()))
    store.clear_stage()
    return report.counts


def _move_cursor(store: Store, name: str, found: DataFrame, force: bool) -> None:
    latest = services.high_water(found).select(F.date_format("updated", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).first()["at"]
    if latest or force:
        store.write_meta(**{f"issues.{name}.updated": latest})


def _apply(store: Store, report: Report, status: DataFrame, found: DataFrame, settings: Settings, kinds: dict[str, str]) -> None:
    """Extracts the changed items, writes them, and links what they can change."""
    done = status.where("status <> 'skipped'").select(KEYS)
    parts, broken = store.parts(done), store.meta("linking") == "open"  # after a run that broke off, what it changed isn't known
    store.write_meta(linking="open")
    of_code, of_docs = ([p for p in parts if (kinds[p[0]] == "code") == is_code] for is_code in (True, False))
    todo = store.staged(found.join(status.where("status in ('added', 'changed')").select(KEYS), KEYS, "left_semi"))
    of_kind = lambda *k: F.col("source").isin([n for n, kind in kinds.items() if kind in k])
    parsed = code.symbols(todo.where(of_kind("code")).select(F.concat_ws("\t", "source", "path").alias("id"), "path", "language", "content"))
    parsed = store.staged(parsed.withColumns({"source": F.split_part("id", F.lit("\t"), F.lit(1)), "path": F.split_part("id", F.lit("\t"), F.lit(2))}).drop("id"))
    noted = note_fields(todo.where(of_kind("notes")).select(*KEYS, "hash", "updated", F.decode("content", "UTF-8").alias("raw")), "raw", "path")
    if "notes" in kinds.values():
        noted = store.staged(noted)
    # documents that come ready are read from where the items were staged, not written once more
    given = todo.where(of_kind("issues", *PAGES)).select(*KEYS, "hash", "updated", "doc.*").withColumn("links", F.array().cast("array<string>"))
    docs = noted.unionByName(given)
    keys = todo.where(of_kind("code")).select(*KEYS, F.decode("content", "UTF-8").alias("body")).unionByName(docs.where(of_kind(*PAGES)).select(*KEYS, "body"))
    keyed = keys.select(*KEYS, F.explode(text.issue_keys(F.col("body"))).alias("target")).withColumn("what", F.lit("key"))
    symbols = parsed.where("what = 'symbol'")
    symbols = symbols.groupBy(*KEYS, "fqn").agg(F.max_by(F.struct("kind", "name", "signature", "start_line", "end_line", "hash"), F.struct("start_line", "end_line", "hash")).alias("s")).select(*KEYS, "fqn", "s.*")
    candidates = parsed.where("what <> 'symbol'").select(*KEYS, "what", "fqn", "target", "confidence", "evidence")
    linked = noted.select(*KEYS, F.explode("links").alias("target")).withColumn("what", F.lit("link"))
    candidates = candidates.unionByName(linked.unionByName(keyed), allowMissingColumns=True).dropDuplicates([*KEYS, "what", "fqn", "target"])

    old_symbols, old_docs = store.of("symbol", done, of_code).select("source", "name", "fqn"), store.of("document", done, of_docs).select(*KEYS, "title", "aliases")
    names = store.staged(old_symbols.unionByName(symbols.select("source", "name", "fqn")).distinct())
    ends = store.staged(old_docs.unionByName(docs.select(*KEYS, "title", "aliases")).distinct())
    paths = status.where("status in ('added', 'removed')").select(KEYS)

    always = F.lit(True)
    report.close(store.put("symbol", report.watch(symbols, {"symbols": always}), done, of_code))
    store.put("candidate", candidates, done, parts)
    whats = {r.what for r in store.read("candidate").select("what").distinct().collect()}  # four at most
    report.close(store.put("document", report.watch(docs.drop("links"), {"documents": always}), done, of_docs))
    if settings.embedder.enabled:
        report.close(store.put("chunk", report.watch(embed_chunks(chunks(symbols, docs), settings.embedder), {"chunks": always}), done, parts))
    else:
        store.put("chunk", None, done, parts)
    present = store.read("file").join(done, KEYS, "left_anti").select(KEYS).unionByName(status.where("status in ('added', 'changed')").select(KEYS))
    again = store.staged(done.unionByName(present).distinct() if broken else touched(store, done, names, ends, paths, kinds, whats))
    relations = {"imports": ["imports"], "calls": ["calls"], "references": ["references"], "mentions": ["mentions"], "explains": ["explains"], "resolves": ["resolves"], "broken_links": ["broken"]}
    made = report.watch(edges(store, again, done, present, settings, kinds, whats), {c: F.col("relation").isin(r) for c, r in relations.items()})
    report.close(store.put("edge", made.where("relation <> 'broken'"), again))
    store.put("file", todo.select(*KEYS, "kind", "language", "hash", "updated"), done, parts)
    store.write_meta(linking="done")


def chunks(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """A chunk for each symbol; for each document one of its names and one for each window of its body."""
    shown = F.concat_ws("\n", F.concat_ws(" ", "kind", "name"), "fqn", "signature", F.concat(F.lit("file "), "path"))
    s = symbols.select(*KEYS, text.token("symbol", F.col("source"), F.col("fqn")).alias("parent"), F.lit(0).alias("ordinal"), shown.alias("text"))
    d = docs.withColumn("parent", text.token("document", F.col("source"), F.col("path")))
    heads = d.select(*KEYS, "parent", F.lit(0).alias("ordinal"), F.concat_ws("\n", "title", F.array_join("tags", " "), F.array_join("aliases", " ")).alias("text"))
    windows = text.chunk_rows(d.select(*KEYS, "parent", "body"), "body").select(*KEYS, "parent", (F.col("ordinal") + 1).alias("ordinal"), F.col("chunk").alias("text"))
    return s.unionByName(heads).unionByName(windows)


def _keyed(source: str, path: str) -> F.Column:
    return F.concat_ws("\t", source, path)


def _bases(imports: DataFrame) -> DataFrame:
    """import candidates -> id (source, path, target), base (source, path without ending), base_ord."""
    wanted = import_bases(imports.select(F.concat_ws("\t", "source", "path", "target").alias("id"), "path", "target"))
    return wanted.withColumn("base", F.concat_ws("\t", F.split_part("id", F.lit("\t"), F.lit(1)), "base"))


def _of_what(candidates: DataFrame, what: str, whats: set[str]) -> DataFrame:
    """Candidates of a kind; where there is none at all the planner knows, so that nothing is read or shuffled to be joined with them."""
    return candidates.where(F.col("what") == what if what in whats else F.lit(False))


def touched(store: Store, done: DataFrame, names: DataFrame, ends: DataFrame, paths: DataFrame, kinds: dict[str, str], whats: set[str]) -> DataFrame:
    """Files whose edges can change: those done, and those that name a symbol, path, note or issue that appeared or went.

    names(source, name, fqn) and ends(source, path, title, aliases) are of files done, before and after. Mentions
    are found by one scan of the stored bodies against the changed names. whats: the kinds of candidates that are stored.
    """
    c = store.read("candidate")
    calls = _of_what(c, "call", whats).join(names.select("source", F.col("name").alias("target")).distinct(), ["source", "target"], "left_semi")
    tried = _bases(_of_what(c, "import", whats)).select("id", "base")
    suffixes = F.explode(F.array(*map(F.lit, link.SUFFIXES)))
    imports = tried.select("id", "base", suffixes.alias("end")).withColumn("base", F.concat("base", "end")).join(paths.select(_keyed("source", "path").alias("base")).distinct(), "base", "left_semi")
    imports = imports.select(F.split_part("id", F.lit("\t"), F.lit(1)).alias("source"), F.split_part("id", F.lit("\t"), F.lit(2)).alias("path"))
    keys = link.link_targets(ends).select("source", F.lower("key").alias("key")).distinct()
    links = _of_what(c, "link", whats).withColumn("key", F.lower("target")).join(keys, ["source", "key"], "left_semi")
    issues = ends.where(F.col("source").isin([n for n, k in kinds.items() if k == "issues"])).select(F.col("path").alias("target")).distinct()
    cited = _of_what(c, "key", whats).join(issues, "target", "left_semi")
    tokens = names.select(F.explode(F.array("name", "fqn")).alias("token")).distinct()
    said = store.read("document").select(*KEYS, F.explode(text.identifiers(F.col("body"))).alias("token")).join(tokens, "token", "left_semi")
    out = done.select(KEYS)
    for more in (calls, imports, links, cited, said):
        out = out.unionByName(more.select(KEYS))
    return out.distinct()


def edges(store: Store, of: DataFrame, done: DataFrame, present: DataFrame, settings: Settings, kinds: dict[str, str], whats: set[str]) -> DataFrame:
    """All edges that come from the files in of (source, path), all files being present.

    source, path, relation, src, dst and what is known of each; links to nothing have the relation `broken`. What was
    promoted by hand stays as long as the document is the same and still mentions the symbol.
    """
    parts = store.parts(of)
    s, d, c = (store.of(table, of, parts) for table in ("symbol", "document", "candidate"))
    node = lambda kind, source, key: text.token(kind, F.col(source), F.col(key))
    every_symbol = store.read("symbol").select("source", "path", "name", "fqn")

    def made(rows: DataFrame, relation: str, src: F.Column, dst: F.Column, **more: F.Column) -> DataFrame:
        extra = [more.get(k, F.lit(None).cast(t)).cast(t).alias(k) for k, t in (("confidence", "double"), ("evidence", "string"), ("promoted_from", "string"))]
        return rows.select(*KEYS, F.lit(relation).alias("relation"), src.alias("src"), dst.alias("dst"), *extra)

    root = F.concat(F.lit("source:"), "source")
    code_files = present.where(F.col("source").isin([n for n, k in kinds.items() if k == "code"])).join(of, KEYS, "left_semi")
    out = made(code_files, "contains", root, node("file", "source", "path")).unionByName(made(d, "contains", root, node("document", "source", "path")))
    out = out.unionByName(made(s, "defines", node("file", "source", "path"), node("symbol", "source", "fqn")))

    imports = _of_what(c, "import", whats)
    to = link.resolve_imports(_bases(imports), present.select(_keyed("source", "path").alias("path"))).select(F.col("id").alias("_id"), F.split_part("path", F.lit("\t"), F.lit(2)).alias("to"))
    imported = imports.withColumn("_id", F.concat_ws("\t", "source", "path", "target")).join(to, "_id").where("path <> to")
    out = out.unionByName(made(imported, "imports", node("file", "source", "path"), node("file", "source", "to"), confidence=F.col("confidence"), evidence=F.col("evidence")))

    calls = _of_what(c, "call", whats).withColumn("call_id", F.concat_ws("\t", "source", "path", "fqn", "target"))
    called = link.resolve_calls(calls.select("call_id", "source", F.col("target").alias("name"), F.col("path").alias("file")), every_symbol.withColumnRenamed("path", "file"))
    called = calls.join(called.withColumnRenamed("fqn", "to"), "call_id").where("fqn <> to")
    out = out.unionByName(made(called, "calls", node("symbol", "source", "fqn"), node("symbol", "source", "to"), confidence=F.col("confidence"), evidence=F.col("evidence")))

    links = _of_what(c, "link", whats).withColumn("id", _keyed("source", "path"))
    ends = link.resolve_wikilinks(links.select("id", "source", "target"), store.read("document").select("source", "path", "title", "aliases")).withColumnRenamed("path", "to")
    noted = links.join(ends, ["id", "source", "target"])
    to_doc = F.when(F.col("to").isNotNull(), node("document", "source", "to")).otherwise(F.col("target"))
    noted = made(noted, "references", node("document", "source", "path"), to_doc, evidence=F.when(F.col("to").isNull(), F.lit("broken"))).withColumn("relation", F.when(F.col("evidence") == "broken", "broken").otherwise(F.col("relation"))).withColumn("evidence", F.lit(None).cast("string"))
    out = out.unionByName(noted)

    by = link.mentions(d.where(~F.col("source").isin([n for n, k in kinds.items() if k == "issues"])).select(_keyed("source", "path").alias("doc_id"), F.col("body").alias("text")), every_symbol, settings.mention_threshold)
    by = by.select(F.split_part("doc_id", F.lit("\t"), F.lit(1)).alias("_s"), F.split_part("doc_id", F.lit("\t"), F.lit(2)).alias("path"), node("symbol", "source", "fqn").alias("to"), "confidence", "evidence").withColumnRenamed("_s", "source")
    out = out.unionByName(made(by, "mentions", node("document", "source", "path"), F.col("to"), confidence=F.col("confidence"), evidence=F.col("evidence")))
    if settings.promote_from is not None:
        sure = by.where(F.col("confidence") >= settings.promote_from)
        from_ = F.concat_ws(":", F.lit("mentions"), node("document", "source", "path"), "to")
        out = out.unionByName(made(sure, "explains", node("document", "source", "path"), F.col("to"), confidence=F.col("confidence"), evidence=F.col("evidence"), promoted_from=from_))

    held = store.of("edge", of, parts).where("relation = 'explains'").join(done, KEYS, "left_anti")
    still = by.select("source", "path", F.col("to").alias("dst")).distinct()
    out = out.unionByName(held.join(still, [*KEYS, "dst"], "left_semi").select(out.columns))

    issues = store.read("document").where(F.col("source").isin([n for n, k in kinds.items() if k == "issues"])).groupBy(F.col("path").alias("target")).agg(F.min(node("document", "source", "path")).alias("to"))
    cited = _of_what(c, "key", whats).join(issues, "target")
    out = out.unionByName(made(cited.join(s.select(*KEYS, F.col("fqn").alias("own")), KEYS), "resolves", node("symbol", "source", "own"), F.col("to"), evidence=F.col("target")))
    out = out.unionByName(made(cited.join(d.select(KEYS), KEYS), "references", node("document", "source", "path"), F.col("to"), evidence=F.col("target")))
    return out.dropDuplicates([*KEYS, *EDGE])
