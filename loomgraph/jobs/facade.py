"""What a user asks of the graph: sources, lexical and semantic search, neighbourhoods, contexts, decisions, promotions, health.

Every answer is a DataFrame; as_json() makes JSON rows of any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.functions.embed import Embedder, NoEmbedder
from loomgraph.jobs import decisions
from loomgraph.operators import graph, search
from loomgraph.operators.store import TABLES, VERSION, Store
from loomgraph.sources.connectors import CONNECTORS, Source

#: What the kinds of nodes and the relations are: kind, from, to, meaning.
LEGEND = (
    ("node", "symbol", None, None, "class, function, module and the like of a source file"), ("node", "file", None, None, "source file"), ("node", "document", None, None, "note, issue or page"),
    ("node", "decision", None, None, "architectural decision"), ("node", "chunk", None, None, "window of a text, with its vector"), ("node", "source", None, None, "configured source"),
    ("edge", "contains", "source", "file|document", "the source holds it"), ("edge", "defines", "file", "symbol", "the file declares it"), ("edge", "calls", "symbol", "symbol", "a call by name"), ("edge", "imports", "file", "file", "an import that was found"),
    ("edge", "references", "document", "document", "a wikilink, or an issue's key"), ("edge", "mentions", "document", "symbol", "the text names it"), ("edge", "explains", "document", "symbol", "a mention that was promoted"),
    ("edge", "about", "decision", "symbol|file|document", "the decision concerns it"), ("edge", "resolves", "symbol", "document", "the symbol's file names the issue"),
)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object: json; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


class Graph:
    def __init__(self, store: Store, embedder: Embedder | None = None):
        self.store, self.embedder, self.spark = store, embedder or NoEmbedder(), store.spark

    # --- sources and counts ----------------------------------------------------------------------

    def list_sources(self) -> DataFrame:
        """Every source with its numbers of files, symbols and documents, zeros kept."""
        out = self.store.read("source").select(F.col("path").alias("name"), "kind", "root_path", "last_indexed")
        code = F.col("kind") == "code"
        for name, rows in (("files", self.store.read("file").where(code)), ("symbols", self.store.read("symbol")), ("documents", self.store.read("document"))):
            out = out.join(rows.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias(name)), "name", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
        return out.orderBy("name")

    def status(self) -> DataFrame:
        """Rows of each table."""
        counts = [self.store.read(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def legend(self) -> DataFrame:
        return self.spark.createDataFrame(LEGEND, "what string, kind string, from_kind string, to_kind string, meaning string")

    def _allowed(self, rows: DataFrame, sources: list[str] | None) -> DataFrame:
        names = search.allowed(self.store.read("source").select(F.col("path").alias("name"), "kind"), sources)
        return rows if names is None else rows.join(F.broadcast(names), "source", "left_semi")  # as many as there are sources

    # --- search ----------------------------------------------------------------------------------

    def search_symbols(self, needle: str, limit: int | None = None, sources: list[str] | None = None) -> DataFrame:
        """Symbols whose name or full name holds the needle, shortest full names first."""
        n, order = search.clamp_limit(limit), [F.octet_length("fqn"), F.col("fqn"), F.col("source"), F.col("path")]
        found = self._allowed(self.store.read("symbol").where(search.has(needle, "fqn", "name")), sources)
        found = search.first_per_source(found, order, n).orderBy(*order).limit(n)
        return found.select(text.token("symbol", F.col("source"), F.col("fqn")).alias("token"), "source", "kind", "name", "fqn", "signature", "path", "start_line", "end_line")

    def search_documents(self, needle: str, limit: int | None = None, sources: list[str] | None = None) -> DataFrame:
        """Documents whose title or body holds the needle, with an excerpt."""
        n, order = search.clamp_limit(limit), [F.col("title"), F.col("source"), F.col("path")]
        found = self._allowed(self.store.read("document").where(search.has(needle, "title", "body")), sources)
        found = search.first_per_source(found, order, n).orderBy(*order).limit(n)
        shown = F.coalesce(text.excerpt(F.col("body"), needle.strip()), F.col("title"))
        return found.select(text.token("document", F.col("source"), F.col("path")).alias("token"), "source", "path", "title", shown.alias("excerpt"))

    def semantic_search(self, query: str, limit: int | None = None, sources: list[str] | None = None) -> DataFrame:
        """One ranked list over vectors (with an embedder), chunks, symbols and documents, lifted by the graph: also mode and truncated."""
        n = search.clamp_limit(limit)
        ask = lambda d: d.withColumn("query_id", F.lit(0))
        found = search.hits(ask(self.search_symbols(query, n, sources)), "symbol", F.col("token"), excerpt=F.coalesce("signature", "fqn"))
        found = found.unionByName(search.hits(ask(self.search_documents(query, n, sources)), "document", F.col("token"), excerpt=F.col("excerpt")))
        chunks = self._allowed(self.store.read("chunk"), sources)
        held = chunks.where(search.has(query, "text")).orderBy("parent", "ordinal").limit(n)
        found = found.unionByName(search.hits(ask(held), "chunk", F.col("parent"), ordinal=F.col("ordinal"), excerpt=text.excerpt(F.col("text"), query.strip())))
        if self.embedder.enabled:
            near = self.nearest_chunks(query, n, chunks)
            found = found.unionByName(search.hits(ask(near), "vector", F.col("parent"), search.distance_to_score(F.col("distance")), F.col("ordinal"), F.coalesce(text.excerpt(F.col("text"), query.strip()), F.substring("text", 1, 160))))
        out = search.lifted(self.store.staged(search.fused(found, n)), self.store.read("edge").select("relation", "src", "dst").distinct(), limit=n)
        return out.drop("query_id").withColumn("mode", F.lit("hybrid" if self.embedder.enabled else "fts")).orderBy("rank")

    def nearest_chunks(self, query: str, k: int = search.LIMIT, chunks: DataFrame | None = None) -> DataFrame:
        """The chunks nearest to a text: parent, ordinal, text, distance."""
        vector = [float(x) for x in self.embedder.embed([query])[0]]
        asked = self.spark.createDataFrame([("", vector)], "id string, embedding array<float>")
        key = F.concat_ws("#", "parent", F.lpad(F.col("ordinal").cast("string"), 10, "0"))
        chunks = (self.store.read("chunk") if chunks is None else chunks).withColumn("id", key)
        near = search.nearest(chunks, asked, k, id_="id").select("id", "distance")
        return chunks.join(near, "id").select("parent", "ordinal", "text", "distance")

    # --- graph -----------------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        return graph.stored_nodes(self.store)

    def graph_neighbors(self, token: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
        """Edges of a node's neighbourhood with the labels of both ends: relation, src, dst, src_label, dst_label, truncated."""
        root = self.spark.createDataFrame([(token,)], "node string").select(text.canonical_token(F.col("node")).alias("node")).where("node is not null")
        edges, nodes = self.store.read("edge").select("relation", "src", "dst").distinct(), self.nodes()
        found = graph.neighborhood(edges, root.join(nodes.select(F.col("id").alias("node")), "node", "left_semi"), search.clamp_depth(depth), search.clamp_limit(limit))
        label = lambda end: nodes.select(F.col("id").alias(end), F.coalesce("title", "name", "key").alias(f"{end}_label"))
        return graph.edges_within(edges, found).join(label("src"), "src", "left").join(label("dst"), "dst", "left").select("relation", "src", "dst", "src_label", "dst_label", "truncated")

    def explore_context(self, needle: str, limit: int | None = None, sources: list[str] | None = None) -> DataFrame:
        """Hits of symbols and documents and the graph around the best of each: see search.explored()."""
        n, asked = search.clamp_limit(limit), F.lit(",".join(sources) if sources else None).cast("string")

        def numbered(rows: DataFrame, *order: F.Column) -> DataFrame:
            nth = F.row_number().over(search.W.partitionBy("query_id").orderBy(*order))
            return rows.withColumns({"query_id": F.lit(needle), "source_filter": asked}).withColumn("nth", nth).withColumnRenamed("token", "id")

        symbols = numbered(self.search_symbols(needle, n, sources), F.octet_length("fqn"), F.col("fqn"), F.col("source"))
        documents = numbered(self.search_documents(needle, n, sources), F.col("title"), F.col("source"), F.col("path"))
        return search.explored(symbols, documents, self.store.read("edge").select("relation", "src", "dst").distinct(), self.nodes(), n)

    # --- writing back ----------------------------------------------------------------------------

    def add_decisions(self, rows: DataFrame, created_by: str = "agent", vault: Source | None = None) -> dict[str, int]:
        return decisions.add_decisions(self.store, rows, created_by, vault)

    def promote_mentions(self, threshold: float = 0.0, document: str | None = None, symbol: str | None = None) -> int:
        """Mentions sure enough (of one document or symbol, if given) become explanations; returns how many are new."""
        found = self.store.read("edge").where((F.col("relation") == "mentions") & (F.col("confidence") >= threshold))
        for column, token in (("src", document), ("dst", symbol)):
            found = found if token is None else found.where(F.col(column) == token)
        origin = F.concat_ws(":", F.lit("mentions"), "src", "dst")
        found = found.withColumn("promoted_from", origin).withColumn("relation", F.lit("explains"))
        return self.store.insert_missing("edge", found, ["source", "path", "relation", "src", "dst"])

    # --- health ----------------------------------------------------------------------------------

    def health(self, sources: list[Source]) -> DataFrame:
        """name, status (ok, warn, fail), detail: the store, its version, each configured source, the vectors. Healthy is what has no fail."""
        version, size = self.store.meta("schema_version"), self.store.meta("embedding_dimension")
        rows = [("store.schema", "ok" if version == VERSION else "warn" if version is None else "fail", f"version {version}, {VERSION} expected")]
        rows += [] if sources else [("sources", "warn", "no source is configured")]
        for s in sources:
            there = self.store._exists(s.root)
            known = s.kind in CONNECTORS
            rows.append((f"source:{s.name}", "fail" if not known else "ok" if there else "warn", f"{s.kind} at {s.root}" if known and there else f"no kind {s.kind}" if not known else f"{s.root} does not exist yet"))
        if not self.embedder.enabled:
            rows.append(("vectors", "ok", "embeddings are off"))
        else:
            fits = size == str(self.embedder.dimension)
            rows.append(("vectors", "ok" if fits else "warn" if size is None else "fail", f"dimension {size} stored, {self.embedder.dimension} configured"))
        return self.spark.createDataFrame(rows, "name string, status string, detail string")
