"""Markup to text: HTML pages and workspace blocks as column expressions, wiki documents (ADF) Arrow-batched."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entities with names, and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "mdash": "—", "ndash": "–", "aacute": "á", "Aacute": "á", "eacute": "é", "Eacute": "é",
    "iacute": "í", "Iacute": "í", "oacute": "ó", "Oacute": "ó", "uacute": "ú", "Uacute": "ú", "ntilde": "ñ", "Ntilde": "Ñ",
}
#: Tags that begin a new line, by how they start.
BLOCK_TAG = r"(?i)<(?:p|br|div|h[123]|li|tr|/p|/div|/h|/li|/tr)[^>]*(?:>|\z)"
#: Blanks of Unicode but for the line end.
BLANKS = r"[\t\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PIECES = r"&#[0-9]{1,9};|&#[xX][0-9a-fA-F]{1,7};|&[A-Za-z]{1,10};|[^&]+|&"


def entities(text: Column) -> Column:
    """Entities decoded in one pass, so that what comes out of one isn't decoded again; unknown ones stay."""

    def one(piece: Column) -> Column:
        number = F.when(F.startswith(piece, F.lit("&#")), F.when(F.lower(F.substring(piece, 3, 1)) == "x", F.conv(F.regexp_extract(piece, "[xX](.*);", 1), 16, 10)).otherwise(F.regexp_extract(piece, "([0-9]+);", 1))).try_cast("long")
        scalar = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        shown = F.when(scalar, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        named = F.create_map(*(F.lit(x) for name, sign in ENTITIES.items() for x in (f"&{name};", sign)))
        return F.when(F.startswith(piece, F.lit("&")), F.coalesce(F.try_element_at(named, piece), shown, piece)).otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), one), "")).otherwise(text)


def html_text(page: Column) -> Column:
    """Readable text: scripts, styles and comments cut out whole, a new line at block tags, entities decoded, blanks collapsed, at most one empty line in a row."""
    s = F.coalesce(page, F.lit(""))
    for cut in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        s = F.regexp_replace(s, cut, "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\x01", " "), BLOCK_TAG, "\x01"), r"<[^>]*(?:>|\z)", "")
    s = entities(F.regexp_replace(F.regexp_replace(s, "\n\x01+", "\n"), "\x01+", "\n"))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, BLANKS, " "), " ?\n ?", "\n"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\n+", ""), "\n{3,}", "\n\n"), r"\n+\z", "")


def adf_text(node: dict | list | None) -> str:
    """Plain text of a wiki document tree."""
    if isinstance(node, list):
        return "".join(map(adf_text, node))
    if not isinstance(node, dict):
        return ""
    inner, kind = adf_text(node.get("content")), node.get("type")
    level = (node.get("attrs") or {}).get("level", 2)
    match kind:
        case "text":
            return node.get("text", "")
        case "hardBreak":
            return "\n"
        case "paragraph":
            return f"{inner}\n"
        case "heading":
            return f"{'#' * max(2, min(6, int(level)))} {inner}\n"
        case "listItem":
            return f"- {inner.strip()}\n"
        case "codeBlock":
            return f"```\n{inner}\n```\n"
        case "blockquote":
            return f"> {inner.strip()}\n"
        case "rule":
            return "---\n"
        case "media" | "mediaSingle" | "mediaGroup":
            return ""
    return inner


@F.pandas_udf(StringType())
def adf_to_text(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A tree of any depth is no column expression; a plain string is its own text."""

    def one(value: str | None) -> str:
        try:
            return adf_text(json.loads(value)).strip() if value else ""
        except ValueError:
            return value.strip() if value[:1] not in "{[" else ""

    for batch in docs:
        yield batch.map(one, na_action=None)


#: How each kind of workspace block is led in, and ended.
LEADS = {
    "paragraph": ("", "\n\n"), "heading_1": ("# ", "\n\n"), "heading_2": ("## ", "\n\n"), "heading_3": ("### ", "\n\n"), "bulleted_list_item": ("- ", "\n"),
    "numbered_list_item": ("- ", "\n"), "quote": ("> ", "\n\n"), "callout": ("> ", "\n\n"), "toggle": ("", "\n\n"),
}
SILENT = ("image", "file", "video", "pdf", "audio", "table", "column_list", "column", "synced_block")


def rich_text(items: Column) -> Column:
    """Plain text of a JSON list of runs."""
    return F.coalesce(F.array_join(F.from_json(items, "array<struct<plain_text:string>>")["plain_text"], ""), F.lit(""))


def block_text(block: Column) -> Column:
    """Markdown of one workspace block, given as JSON, without its children."""
    kind = F.coalesce(F.get_json_object(block, "$.type"), F.lit(""))
    body = F.try_element_at(F.from_json(block, "map<string,string>"), kind)
    field = lambda path: F.get_json_object(body, path)
    text = rich_text(F.coalesce(field("$.rich_text"), field("$.text")))
    url = F.coalesce(field("$.url"), F.lit(""))
    out = F.when(kind.isin("paragraph") & (text == ""), "")
    for name, (before, after) in LEADS.items():
        out = out.when(kind == name, F.concat(F.lit(before), text, F.lit(after)))
    return (
        out.when(kind == "to_do", F.concat(F.lit("- ["), F.when(field("$.checked") == "true", "x").otherwise(" "), F.lit("] "), text, F.lit("\n")))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(field("$.language"), F.lit("")), F.lit("\n"), text, F.lit("\n```\n\n"))).when(kind == "divider", "---\n\n")
        .when(kind == "child_page", F.concat(F.lit("[page: "), F.coalesce(field("$.title"), F.lit("child page")), F.lit("]\n\n")))
        .when(kind == "child_database", F.concat(F.lit("[database: "), F.coalesce(field("$.title"), F.lit("database")), F.lit("]\n\n")))
        .when(kind.isin("bookmark", "link_preview", "embed"), F.when(url == "", "").otherwise(F.concat(url, F.lit("\n\n")))).when(kind.isin(*SILENT) | (text == ""), "").otherwise(F.concat(text, F.lit("\n")))
    )


def page_title(properties: Column) -> Column:
    """The first title that isn't blank among a page's properties, given as JSON, by their names."""
    found = F.array_sort(F.map_entries(F.from_json(properties, "map<string,struct<type:string,title:array<struct<plain_text:string>>>>")))
    titles = F.transform(F.filter(found, lambda e: e["value"]["type"] == "title"), lambda e: F.trim(F.array_join(e["value"]["title"]["plain_text"], "")))
    return F.coalesce(F.get(F.filter(titles, lambda x: x != ""), F.lit(0)), F.lit("Untitled"))
