"""Text functions as column expressions: identifiers, issue keys, notes, paths, chunks, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk windows: characters of a window, characters shared by neighbours.
WINDOW, OVERLAP = 1200, 150
#: Extensions of attachments, which a wikilink may name without naming a note.
ATTACHMENTS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "pdf", "mp3", "mp4", "wav", "mov", "zip", "csv", "xlsx", "docx")


def identifiers(body: Column) -> Column:
    """Maximal runs of letters, digits, `_` and `:`, two characters or more; a trailing `:` stays."""
    return F.regexp_extract_all(body, F.lit("[A-Za-z0-9_:]{2,}"), F.lit(0))


def issue_keys(text: Column) -> Column:
    """Distinct issue keys such as QX-901, in order of appearance; only where a capital stands is looked at what is before it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z](?<![A-Za-z0-9_][A-Z])[A-Za-z0-9]{1,9}-[0-9]{1,6}(?![A-Za-z0-9_])"), F.lit(0)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def language(path: Column) -> Column:
    """Language of a source file by extension or name; null for other files."""
    ext, name = extension(path), F.regexp_extract(path, "([^/]*)$", 1)
    return (
        F.when(ext == "rs", "rust").when(ext.isin("ts", "tsx"), "typescript").when(ext == "py", "python")
        .when(ext.isin("rb", "rake", "gemspec") | name.isin("Rakefile", "Gemfile"), "ruby")
    )


def folded(path: Column) -> Column:
    """A relative path with `.`, `..` and empty parts folded; null for one that climbs out of the root."""
    parts = F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    up = lambda s, p: F.when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1))
    return F.aggregate(parts, F.array().cast("array<string>"), up, lambda s: F.array_join(s, "/"))


def module_path(path: Column) -> Column:
    """Path to module name: known suffixes off, slashes to `::`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.(tsx|ts|rs|py|rb)$", ""), "/(mod|index)$", ""), "/", "::")


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path holds one of the patterns, their outer `*` and `/` taken off."""
    out = F.lit(False)
    for p in patterns:
        if p.strip("*/"):
            out = out | F.contains(path, F.lit(p.strip("*/")))
    return out


def front_matter(raw: Column) -> Column:
    """Struct of the block between `---` lines at the start (null without one) and the body."""
    text = F.regexp_replace(raw, "\r\n", "\n")
    block = r"(?s)^---\n(.*?)\n---(?:\n|$)"
    return F.when(text.rlike(block), F.struct(F.regexp_extract(text, block, 1).alias("head"), F.regexp_replace(text, block, "").alias("body"))).otherwise(F.struct(F.lit(None).cast("string").alias("head"), text.alias("body")))


def head_value(head: Column, key: str) -> Column:
    """Scalar of a front matter key, unquoted; null if absent or empty."""
    v = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.nullif(F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""), F.lit(""))


def head_list(head: Column, key: str) -> Column:
    """List of a front matter key: `[a, b]`, `- a` lines or a scalar."""
    inline = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]*.*(?:\n|$))+)", 1)
    items = F.when(inline != "", F.split(inline, ",")).when(block != "", F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*(.*)$"), F.lit(1)), lambda x: x)).when(head_value(head, key).isNotNull() & ~F.startswith(head_value(head, key), F.lit("[")), F.array(head_value(head, key)))
    clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.coalesce(F.filter(clean, lambda x: x != ""), F.array().cast("array<string>"))


def first_heading(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^[ \t]*#+[ \t]+(.+)$", 1)), F.lit(""))


def inline_tags(body: Column) -> Column:
    """`#tag` words of a body: letters, digits, `_` and `-`."""
    return F.regexp_extract_all(body, F.lit(r"(?:^|[\s.,;:!?()\[\]{}])#([A-Za-z0-9_-]+)(?=$|[\s.,;:!?()\[\]{}])"), F.lit(1))


def wikilinks(body: Column) -> Column:
    """Targets of `[[target#part|shown]]` links, embeds included, duplicates kept, attachments and blanks dropped."""
    raw = F.regexp_extract_all(body, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    targets = F.transform(raw, lambda x: F.trim(F.replace(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("\\"), F.lit("/"))))
    return F.filter(targets, lambda x: (x != "") & ~F.lower(F.regexp_extract(x, r"\.([^./]+)$", 1)).isin(*ATTACHMENTS))


def chunks(body: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of windows of the trimmed body, `overlap` characters shared; empty for blank bodies."""
    window = max(64, window)
    step = window - min(overlap, window // 2)
    b = F.regexp_replace(body, r"^\s+|\s+$", "")
    n = F.length(b)
    count = F.when(n == 0, 0).when(n <= window, 1).otherwise(1 + F.ceil((n - window) / step)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(b, i * step + 1, F.lit(window)))).otherwise(F.array().cast("array<string>"))


def chunk_rows(docs: DataFrame, body: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """docs(..., body) -> a row for each window of the body, as chunks() has them: ordinal and chunk in place of the body.

    The body is trimmed once, as a column below the rows, so the work is linear in the length of a text.
    """
    window = max(64, window)
    step = window - min(overlap, window // 2)
    keys = [c for c in docs.columns if c != body]
    d = docs.select(*keys, F.regexp_replace(body, r"^\s+|\s+$", "").alias("_body"))
    n = F.length("_body")
    last = F.when(n == 0, -1).when(n <= window, 0).otherwise(F.ceil((n - window) / step)).cast("int")
    d = d.select(*keys, "_body", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("ordinal"))
    return d.select(*keys, "ordinal", F.substring("_body", F.col("ordinal") * step + 1, F.lit(window)).alias("chunk"))


def excerpt(body: Column, needle: str, before: int = 80, window: int = 160) -> Column:
    """The first match of a lower-case needle in bold with its surroundings, on one line."""
    at = F.instr(F.lower(body), needle.lower())
    start = F.greatest(at - before, F.lit(1))
    end = F.least(start + window - 1, F.length(body))
    piece = lambda a, b: F.substring(body, a, F.greatest(b - a + 1, F.lit(0)))
    n = F.lit(len(needle))
    shown = F.concat(
        F.when(start > 1, "…").otherwise(""), piece(start, at - 1), F.lit("**"), F.substring(body, at, n), F.lit("**"), piece(at + n, end),
        F.when(end < F.length(body), "…").otherwise(""),
    )
    return F.when(at > 0, F.regexp_replace(shown, "\n", " "))


def slug(title: Column, default: str = "adr") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


def record_id(key: Column) -> Column:
    """32 hex characters of a business key."""
    return F.substring(F.sha2(key, 256), 1, 32)


def token(kind: str | Column, source: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, source, key)


def parse_token(value: Column) -> Column:
    """kind:source:key, cut at the first two colons."""
    p = F.split(value, ":", 3)
    return F.struct(F.get(p, 0).alias("kind"), F.get(p, 1).alias("source"), F.get(p, 2).alias("key"))


def canonical_token(value: Column) -> Column:
    """A token with its kind's usual name; null for an unknown kind, or a blank source or key."""
    p = F.split(value, ":", 3)
    kind = F.lower(F.get(p, 0))
    kind = F.when(kind.isin("decision", "architecture_decision", "adr"), "decision").when(kind.isin("symbol", "file", "document"), kind)
    source, key = F.get(p, 1), F.get(p, 2)
    return F.when(kind.isNotNull() & (source != "") & (key != ""), F.concat_ws(":", kind, source, key))
