"""Issue trackers, wikis and workspaces: recorded JSON pages, through Spark's reader, to document rows.

A recorded page is a JSON object with a list of items (`items`, `issues` or `results`), as the services
give them; how pages are fetched is left to whoever records them. Documents of all three have the columns
path, title, aliases, tags, body, hash and updated (null if not parsable), which are those of notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import markup

#: Levels of a workspace page below its first that are read, and blocks of one parent.
DEPTH, BLOCKS = 3, 400
DOCUMENT = ("path", "title", "aliases", "tags", "body", "hash", "updated")


def timestamp(text: Column) -> Column:
    """RFC 3339 or `+0000` offsets; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of all recorded pages of a folder: page (file name), parent (of lists of blocks), ord, item (JSON)."""
    pages = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_name").alias("page"), F.from_json("value", "parent string, items array<string>, issues array<string>, results array<string>").alias("v"))
    return pages.select("page", F.col("v.parent").alias("parent"), F.posexplode(F.coalesce("v.items", "v.issues", "v.results")).alias("ord", "item"))


def _field(item: str, path: str) -> Column:
    return F.coalesce(F.get_json_object(item, path), F.lit(""))


def _strings(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def _filled(*values: Column) -> Column:
    """Array of the values that aren't blank."""
    return F.filter(F.array(*values), lambda x: x != "")


def _line(name: str, value: Column, ticked: bool = False) -> Column:
    """`- name: value` with a line end, nothing for a blank value."""
    tick = F.lit("`" if ticked else "")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), tick, value, tick, F.lit("\n"))).otherwise("")


def _body(title: Column, *parts: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), *parts)


def _text(column: str) -> Column:
    return F.when(F.col(column) != "", F.concat(column, F.lit("\n"))).otherwise("")


def _digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def issue_documents(found: DataFrame, base_url: str) -> DataFrame:
    """Issues (item JSON) as documents; issues without a key are left out."""
    description = F.get_json_object("item", "$.fields.description")
    d = found.select(
        _field("item", "$.key").alias("key"), _field("item", "$.fields.summary").alias("summary"), _field("item", "$.fields.status.name").alias("status"), _field("item", "$.fields.issuetype.name").alias("type"),
        _field("item", "$.fields.priority.name").alias("priority"), _field("item", "$.fields.assignee.displayName").alias("assignee"), _strings(F.get_json_object("item", "$.fields.labels")).alias("labels"),
        _field("item", "$.fields.updated").alias("raw"), markup.adf_to_text(description).alias("description"),
    ).where("key <> ''")
    url = F.concat(F.lit(base_url.rstrip("/") + "/browse/"), "key")
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value, F.lit("\n"))
    described = F.when(F.col("description") != "", F.concat(F.lit("## Description\n\n"), "description", F.lit("\n"))).otherwise("")
    body = _body(
        F.col("summary"), F.concat(F.lit("- key: `"), "key", F.lit("`\n")), line("type", F.col("type")), line("status", F.col("status")), _line("priority", F.col("priority")), _line("assignee", F.col("assignee")),
        line("url", url), _line("labels", F.array_join("labels", ", ")), F.lit("\n"), described,
    )
    tags = F.filter(F.concat("labels", F.array("status", "type")), lambda x: x != "")
    return d.select(F.col("key").alias("path"), F.concat("key", F.lit(" — "), "summary").alias("title"), F.array("key").alias("aliases"), tags.alias("tags"), body.alias("body"), _digest("key", "raw", "summary", "status", "description").alias("hash"), timestamp(F.col("raw")).alias("updated"))


def wiki_documents(found: DataFrame, base_url: str) -> DataFrame:
    """Wiki pages (item JSON) as documents: the document tree's text if there is any, else the stored HTML's."""
    base = base_url.rstrip("/")
    d = found.select(
        _field("item", "$.id").alias("id"), _field("item", "$.title").alias("title"), _field("item", "$.space.key").alias("space"), _field("item", "$.version.when").alias("raw"), _field("item", "$._links.webui").alias("link"),
        F.coalesce(F.from_json(F.get_json_object("item", "$.metadata.labels.results"), "array<struct<name:string>>")["name"], F.array().cast("array<string>")).alias("labels"),
        markup.adf_to_text(F.get_json_object("item", "$.body.atlas_doc_format.value")).alias("tree"), F.get_json_object("item", "$.body.storage.value").alias("html"),
    ).where("id <> ''").withColumn("text", F.when(F.col("tree") != "", F.col("tree")).otherwise(markup.html_text(F.col("html"))))
    own = F.concat(F.lit(f"{base}/wiki/spaces/"), "space", F.lit("/pages/"), "id")
    url = F.when(F.startswith("link", F.lit("http")), F.col("link")).when(F.col("link") != "", F.concat(F.lit(f"{base}/wiki"), F.when(F.startswith("link", F.lit("/")), "").otherwise("/"), "link")).otherwise(own)
    body = _body(F.col("title"), _line("space", F.col("space"), True), F.concat(F.lit("- page_id: `"), "id", F.lit("`\n- url: "), url, F.lit("\n")), _line("labels", F.array_join("labels", ", ")), F.lit("\n"), _text("text"))
    aliases = F.array_sort(F.array_distinct(_filled(F.col("title"), F.col("id"), F.when(F.col("space") != "", F.concat_ws("/", "space", "title")).otherwise(""))))
    tags = F.filter(F.concat("labels", F.array("space")), lambda x: x != "")
    return d.select(F.col("id").alias("path"), "title", aliases.alias("aliases"), tags.alias("tags"), body.alias("body"), _digest("id", "raw", "title", "space", "text").alias("hash"), timestamp(F.col("raw")).alias("updated"))


def block_texts(roots: DataFrame, blocks: DataFrame, depth: int = DEPTH, most: int = BLOCKS) -> DataFrame:
    """roots(id), blocks(parent, ord, block JSON) -> id, text: the tree below each root, parents before children.

    A level is one join on the parent. Each block has a path of its places, all of one width, so that sorting the
    paths walks the tree; child pages are documents of their own and are named, not entered. Of one parent `most`
    blocks are read, the last of them without its children. A block that is its own ancestor ends at the depth.
    """
    place = F.row_number().over(W.partitionBy("parent").orderBy("ord"))
    kind = F.coalesce(F.get_json_object("block", "$.type"), F.lit(""))
    b = blocks.withColumn("nth", place).where(F.col("nth") <= most)
    b = b.select("parent", F.lpad(F.col("nth").cast("string"), len(str(most)), "0").alias("nth"), F.get_json_object("block", "$.id").alias("id"), markup.block_text(F.col("block")).alias("text"), ((F.get_json_object("block", "$.has_children") == "true") & ~kind.isin("child_page", "child_database") & (F.col("nth") < most)).alias("enter"))
    level, found = roots.select(F.col("id").alias("root"), F.col("id").alias("parent"), F.lit("").alias("path")).distinct(), None
    for _ in range(depth + 1):
        here = level.join(b, "parent").select("root", F.concat("path", "nth").alias("path"), "text", "id", "enter")
        found = here if found is None else found.unionByName(here)
        level = here.where("enter").select("root", F.col("id").alias("parent"), "path")
    texts = found.where("text <> ''").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("parts"))
    texts = texts.select(F.col("root").alias("id"), F.array_join(F.col("parts.text"), "").alias("text"))
    return roots.select("id").distinct().join(texts, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def workspace_documents(found: DataFrame) -> DataFrame:
    """Workspace pages and lists of blocks (items with page and parent) as documents."""
    kind = F.get_json_object("item", "$.object")
    pages = found.where(kind == "page").select(_field("item", "$.id").alias("id"), markup.page_title(F.get_json_object("item", "$.properties")).alias("title"), _field("item", "$.last_edited_time").alias("raw"), _field("item", "$.url").alias("url")).where("id <> ''").dropDuplicates(["id"])
    blocks = found.where((kind == "block") & F.col("parent").isNotNull()).select("parent", F.struct("page", "ord").alias("ord"), F.col("item").alias("block"))
    d = pages.join(block_texts(pages, blocks), "id")
    body = _body(F.col("title"), F.concat(F.lit("- page_id: `"), "id", F.lit("`\n")), _line("url", F.col("url")), F.lit("\n"), _text("text"))
    return d.select(F.col("id").alias("path"), "title", F.array_sort(F.array_distinct(_filled(F.col("title"), F.col("id")))).alias("aliases"), F.array(F.lit("workspace")).alias("tags"), body.alias("body"), _digest("id", "raw", "title", "text").alias("hash"), timestamp(F.col("raw")).alias("updated"))


# --- cursors -----------------------------------------------------------------------------------------

def updated_since(docs: DataFrame, minute: str) -> DataFrame:
    """Documents updated in the cursor's minute or later; hashes tell those of that minute that were seen before."""
    return docs.where(F.col("updated") >= F.date_trunc("minute", F.lit(minute).cast("timestamp")))


def high_water(docs: DataFrame) -> DataFrame:
    """One row: the latest update among the parsable ones."""
    return docs.agg(F.max("updated").alias("updated"))


def incremental_query(base: str, cursor: str | None) -> str:
    """The service's query narrowed to updates since the cursor, oldest first; its own order is dropped."""
    at = base.upper().rfind("ORDER BY")
    body = (base[:at] if at >= 0 else base).strip()
    since = f'updated >= "{cursor}"' if cursor else ""
    parts = [p for p in (f"({body})" if body and since else body, since) if p]
    return f"{' AND '.join(parts) or 'updated >= -3650d'} ORDER BY updated ASC"
