"""Architectural decisions: rows of the graph, what they are about, and notes of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.graph import node_ids
from loomgraph.operators.store import Store
from loomgraph.sources.connectors import Source
from loomgraph.sources.note_files import write_notes

SOURCE = "system"


def notes(decisions: DataFrame, folder: str = "decisions") -> DataFrame:
    """decisions(title, body, created_at, created_by, about) -> path, text: Markdown with front matter."""
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntags: [adr]\ncreated: "), stamp, F.lit("\ncreated_by: "), "created_by", F.lit("\n---\n\n# "), "title", F.lit("\n\n"), "body", F.lit("\n\n"))
    about = F.concat(F.lit("## About\n\n"), F.array_join(F.transform("about", lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))), ""), F.lit("\n"))
    path = F.concat(F.lit(f"{folder.strip('/')}/" if folder.strip("/") else ""), text.slug(F.col("title")), F.lit(".md"))
    return decisions.select(path.alias("path"), F.concat(head, F.when(F.size("about") > 0, about).otherwise("")).alias("text"))


def add_decisions(store: Store, decisions: DataFrame, created_by: str = "agent", vault: Source | None = None, folder: str = "decisions") -> dict[str, int]:
    """decisions(title, body, about: tokens of nodes) into the store, by title; a second one of a title replaces the first.

    About-edges go to those targets that exist. With a vault of notes each decision is written there as well.
    Returns decisions, about_linked and notes. A blank title or body is an error and nothing is written.
    """
    if vault is not None and vault.kind != "notes":
        raise ValueError("decisions are written to a vault of notes")
    d = decisions.select(F.trim("title").alias("title"), F.trim("body").alias("body"), F.coalesce("about", F.array().cast("array<string>")).alias("about"))
    if d.where("coalesce(title, '') = '' or coalesce(body, '') = ''").limit(1).count():
        raise ValueError("a decision needs a title and a body")
    d = store.one_each(d, ["title"])
    tokens = F.filter(F.transform("about", text.canonical_token), lambda x: x.isNotNull())
    d = store.staged(d.withColumns({"about": F.array_distinct(tokens), "created_at": F.current_timestamp(), "created_by": F.lit(created_by), "source": F.lit(SOURCE), "path": F.col("title")}))
    store.put("decision", d, d)
    asked = d.select("source", "path", F.explode("about").alias("dst"))
    there = asked.join(node_ids(store).select(F.col("id").alias("dst")), "dst", "left_semi")
    edges = store.staged(there.select("source", "path", F.lit("about").alias("relation"), text.token("decision", F.col("source"), F.col("path")).alias("src"), "dst"))
    store.put("edge", edges, d)
    n = d.count()
    if vault is not None:
        write_notes(notes(d, folder), vault.root)
    return {"decisions": n, "about_linked": edges.count(), "notes": n if vault is not None else 0}
