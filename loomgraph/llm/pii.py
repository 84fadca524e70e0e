"""Operator 10, personal data by candidate gradient boosting (DataFrame functions only).

Base spans come from four patterns with their checks. High-recall generators propose further spans,
which may overlap them: groups of digits with loose separators, dotted numbers, `@` tokens and their
spelled-out forms. Every candidate has format features (digits, separators, leading sign, groups) and
context features (signs and cue words around it); boosted trees, grown level by level from sums of
gradients by leaf, feature and bin that Spark gathers, give it a probability of being personal data.
Labels come from normal forms (`labelled`): a candidate is positive if it is a base span or becomes one
once its signs are spelled plainly (`[at]` to `@`, loose separators of a card, `00` or a cue word such as
`tel` in place of `+`). As a corpus may hold few of those forms, every second base span joins the
candidates in such forms too (`disguised`), in its own context. All candidates count: those of equal binned features
and label are one weighted row, which trees can't tell from the single ones. The threshold is the least score at which the held-out fourth of the candidates reaches PRECISION;
candidates from it on that overlap no base span are redacted as well, as kind `other`.

Places are code points: sums of the lengths of matches and of the pieces between them, kept for each
block of matches. Patterns are possessive and start at the edge of a run or where the last match ended,
which finds the same matches in linear time on texts of any length. Candidates meet the base spans of
their text in one window over starts.

Cases: null and empty texts have no spans; an empty table gives no rows, and with no candidates, or of
one label only, nothing is added to the base; repeated rows are read alike; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind can't match; texts without it are passed over.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
GENERATORS = {
    "digits": r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){7,40}",
    "dotted": r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,6}(?![0-9])",
    "at": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]{1,63}+){1,8}",
}
FOUND = "array<struct<s:int,k:int,e:int,kind:string,m:string,before:string,after:string>>"
PLAIN_EMAIL = rf"{LOCAL}+@{DOMAIN}+(?:\.{DOMAIN}+)+"
#: A word just before a number that says it is one to call.
CALLED = r"(?i)\b(tel|telephone|phone|call|mobile|cell|fax)[.:]?[^0-9a-z]{0,3}$"
#: Matches of a text whose lengths are summed at once.
BLOCK = 128
CUES = r"(?i)(tel|phone|call|mail|card|visa|ip|addr|host|contact)"
TREES, DEPTH, SHRINKAGE, LEAST_GAIN, PRECISION = 8, 2, 0.5, 1e-3, 0.98
FEATURES = {
    "n_chars": (4, 8, 10, 12, 14, 16, 18, 20, 24), "n_digits": (0, 4, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 18, 19), "n_groups": (1, 2, 3, 4, 5), "n_dots": (0, 1, 2, 3, 4),
    "n_dashes": (0, 1, 3), "n_spaces": (0, 1, 3), "plus": (0,), "at": (0,), "letters": (0, 5, 10), "brackets": (0,), "lead": (0, 1, 2, 3, 4, 5, 6, 7, 8), "before": (0, 1, 2), "after": (0, 1, 2), "cue": (0,),
}


def matches(text: Column, pattern: str) -> Column:
    """Struct of the match strings and of the pieces around them, one piece more than matches."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))


def placed(d: DataFrame, names: list[str]) -> DataFrame:
    """Adds `name_at` for each column of matches(): where the piece before each match starts.

    Each step reads its column twice outside of lambdas, so that Spark keeps it as a column of its own
    rather than working it out anew for each element.
    """
    n = lambda c: F.size(F.col(c))
    total = lambda c, at, size: F.aggregate(F.slice(c, at + 1, size), F.lit(0), lambda a, v: a + v)
    upto = lambda c: F.sequence(F.lit(0), F.greatest(n(c) - 1, F.lit(0)))

    def lengths(c: str) -> Column:
        return F.when(n(f"{c}.m") > 0, F.transform(F.col(c)["m"], lambda m, i: F.length(F.get(F.col(c)["p"], i)) + F.length(m)))

    def blocks(c: str) -> Column:
        return F.when(n(f"{c}_l") > 0, F.transform(F.sequence(F.lit(0), F.floor((n(f"{c}_l") - 1) / BLOCK).cast("int")), lambda b: total(f"{c}_l", b * BLOCK, F.lit(BLOCK))))

    def starts(c: str) -> Column:
        return F.when(n(f"{c}_b") > 0, F.transform(upto(f"{c}_b"), lambda b: total(f"{c}_b", F.lit(0), b)))

    def at(c: str) -> Column:
        return F.when(n(f"{c}_s") > 0, F.transform(upto(f"{c}_l"), lambda i: F.get(f"{c}_s", F.floor(i / BLOCK).cast("int")) + total(f"{c}_l", i - i % BLOCK, i % BLOCK)))

    for step, f in (("l", lengths), ("b", blocks), ("s", starts), ("at", at)):
        d = d.withColumns({f"{c}_{step}": f(c) for c in names})
    return d


def located(c: str, kind: str) -> Column:
    """Column of matches() with its places -> array of (s, k, e, kind, m, before, after); k is the kind's rank."""
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)
    m, p = F.col(c)["m"], F.col(c)["p"]

    def span(x: Column, i: Column) -> Column:
        start = F.get(f"{c}_at", i) + F.length(F.get(p, i))
        before = F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(p, i)), F.lit(24))
        after = F.left(F.concat(F.get(p, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(8))
        return F.struct(start.alias("s"), F.lit(rank).alias("k"), (start + F.length(x)).alias("e"), F.lit(kind).alias("kind"), x.alias("m"), before.alias("before"), after.alias("after"))

    return F.when(F.size(f"{c}_at") > 0, F.transform(m, span))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)
    values = F.transform(F.split(back, ""), lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255))
    n = F.length(digits(m))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(m))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base (s, k, e, kind, m, sorted) and cand (s, e, m, before, after)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns({f"_{k}": F.when(F.lit(True) if not NEEDS[k] else F.instr("text", NEEDS[k]) > 0, matches(F.col("text"), PATTERNS[k])) for k in KINDS})
    d = d.withColumns({f"_{g}": F.when(F.instr(F.lower("text"), "@") + F.instr(F.lower("text"), "at") > 0 if g == "at" else F.col("text").rlike("[0-9]"), matches(F.col("text"), p)) for g, p in GENERATORS.items()})
    d = placed(d, [f"_{n}" for n in (*KINDS, *GENERATORS)])
    passing = lambda k: F.filter(located(f"_{k}", k), lambda x: valid(k, x["m"])).alias(k)
    d = d.select("doc_id", *map(passing, KINDS), *(located(f"_{g}", g).alias(g) for g in GENERATORS))
    fields = lambda names, of: F.concat(*(F.transform(F.coalesce(n, F.array().cast(FOUND)), lambda x: F.struct(*(x[f].alias(f) for f in of))) for n in names))
    return d.select("doc_id", F.array_sort(fields(KINDS, ("s", "k", "e", "kind", "m"))).alias("base"), fields(GENERATORS, ("s", "e", "m", "before", "after")).alias("cand"))


def compared(found: DataFrame) -> DataFrame:
    """found(row, base, cand) -> each candidate with exact (is a base span) and over (overlaps one).

    Base spans come before the candidates that end after their start; the furthest end so far tells
    whether one reaches into a candidate. One shuffle by row; a row's spans are sorted, not held.
    """
    b = found.select("row", F.explode("base").alias("x")).select("row", "x.s", "x.e", "x.m", F.lit("").alias("before"), F.lit("").alias("after"), F.lit(True).alias("own"), F.col("x.s").alias("o"))
    c = found.select("row", F.explode("cand").alias("x")).select("row", "x.s", "x.e", "x.m", "x.before", "x.after", F.lit(False).alias("own"), (F.col("x.e") - 1).alias("o"))
    # at equal o the base comes first
    reach = F.max(F.when(F.col("own"), F.col("e"))).over(W.partitionBy("row").orderBy("o", F.col("own").cast("int").desc()).rowsBetween(W.unboundedPreceding, 0))
    same = F.max(F.col("own")).over(W.partitionBy("row", "s", "e"))
    both = b.unionByName(c).withColumn("reach", reach).withColumn("exact", same)
    return both.where("not own").select("row", "s", "e", "m", "before", "after", "exact", (F.coalesce("reach", F.lit(0)) > F.col("s")).alias("over"))


def labelled(c: DataFrame) -> DataFrame:
    """Adds the label: 1 for base spans and for what is one in its normal form."""
    plain = F.regexp_replace(F.regexp_replace("m", r"(?i)\x20?[\[(]at[\])]\x20?", "@"), r"(?i)\x20?[\[(]dot[\])]\x20?", ".")
    number, n = digits(F.col("m")), F.length(digits(F.col("m")))
    letters = F.col("m").rlike("[@A-Za-z]")
    dated = F.col("m").rlike(r"^(19|20)[0-9]{2}[-.](0[0-9]|1[0-2])[-.]")
    dotted = F.col("m").rlike(r"^[0-9]{1,4}(\.[0-9]{1,4}){2,6}$")
    card = (n >= 13) & (n <= 19) & luhn(number)
    phone = (n >= 9) & (n <= 15) & (F.startswith("m", F.lit("+")) | F.startswith(number, F.lit("00")) | F.col("before").rlike(CALLED)) & ~dated & ~dotted
    return c.withColumn("label", F.when(F.col("exact"), 1).when(letters, plain.rlike("^" + PLAIN_EMAIL + "$").cast("int")).otherwise((card | phone).cast("int")))


def disguised(c: DataFrame) -> DataFrame:
    """Every second base span among the candidates in forms that the base doesn't know, as further candidates."""
    m, picked = F.col("m"), c.where(F.col("exact") & (F.pmod(F.xxhash64("m"), F.lit(2)) == 0))
    email = F.array(F.regexp_replace(F.regexp_replace(m, "@", " [at] "), r"\.", " [dot] "), F.regexp_replace(m, "@", " (at) "), F.regexp_replace(F.regexp_replace(m, "@", "[at]"), r"\.", "[dot]"))
    phone = F.array(F.regexp_replace(m, r"^\+", "00"), F.regexp_replace(F.regexp_replace(m, r"^\+", "00"), r"[() .]+", "-"))
    card = F.array(F.regexp_replace(digits(m), "([0-9]{4})(?=[0-9])", "$1."), F.regexp_replace(digits(m), "([0-9]{4})(?=[0-9])", "$1  "))
    forms = F.when(F.instr(m, "@") > 0, email).when(F.startswith(m, F.lit("+")), phone).when(~m.rlike(r"[.]"), card)
    return picked.withColumn("m", F.explode(forms)).withColumns({"exact": F.lit(False), "label": F.lit(1)})


def features(c: DataFrame) -> DataFrame:
    """Adds the binned features of candidates: for each, how many of its edges the value passes."""
    m = F.col("m")
    side = lambda ch: F.when(ch == "", 0).when(ch.rlike(r"^\s$"), 1).when(ch.rlike(r"^[.,;:!?)\]]$"), 2).otherwise(3)
    count = lambda p: F.regexp_count(m, F.lit(p))
    values = {
        "n_chars": F.length(m), "n_digits": F.length(digits(m)), "n_groups": count("[0-9]+"), "n_dots": count(r"\."), "n_dashes": count("-"), "n_spaces": count(" "),
        "plus": F.startswith(m, F.lit("+")).cast("int"), "at": F.instr(m, "@"), "letters": count("[A-Za-z]"), "brackets": count(r"[()\[\]]"), "lead": F.coalesce(F.substring(digits(m), 1, 1).try_cast("int"), F.lit(0)),
        "before": side(F.right("before", F.lit(1))), "after": side(F.substring("after", 1, 1)), "cue": F.col("before").rlike(CUES).cast("int"),
    }
    return c.withColumns({f"f_{k}": sum(((v > edge).cast("int") for edge in FEATURES[k]), F.lit(0)) for k, v in values.items()})


def tree_value(tree: list | float) -> Column:
    """(feature, bin, left, right) or a leaf, as an expression."""
    if isinstance(tree, float):
        return F.lit(tree)
    name, bin_, low, high = tree
    return F.when(F.col(f"f_{name}") <= bin_, tree_value(low)).otherwise(tree_value(high))


def rounded(x: float) -> float:
    """Nine digits: the order of a sum doesn't decide between equal cuts."""
    return float(f"{x:.9g}")


def boost(sample: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list]:
    """Trees from the sample (features binned, label 0 or 1, weight), by sums of gradients for each leaf, feature and bin.

    A round gathers one small table a level: leaves x features x bins.
    """
    n, pos = sample.agg(F.sum("weight"), F.sum(F.col("label") * F.col("weight"))).first()
    if not n or not 0 < pos < n:
        return 0.0, []
    start, grown = math.log(pos / (n - pos)), []
    for _ in range(trees):
        margin = sum((tree_value(t) for t in grown), F.lit(start))
        p = 1 / (1 + F.exp(-margin))
        g = sample.withColumns({"g": (F.col("label") - p) * F.col("weight"), "h": p * (1 - p) * F.col("weight")})
        cuts: dict[int, tuple[str, int]] = {}
        sums: dict[int, tuple[float, float]] = {}
        for level in range(depth + 1):
            leaf = F.lit(0)
            for node in sorted(cuts):  # nodes in breadth-first numbers, 0 the root
                leaf = F.when(leaf == node, F.when(F.col(f"f_{cuts[node][0]}") <= cuts[node][1], 2 * node + 1).otherwise(2 * node + 2)).otherwise(leaf)
            pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f"f_{k}").alias("bin")) for k in FEATURES)))
            rows = g.select(leaf.alias("leaf"), "g", "h", pairs.alias("x")).groupBy("leaf", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for node in {r.leaf for r in rows}:
                own = [r for r in rows if r.leaf == node and r.feature == "n_chars"]
                sums[node] = sum(r.g for r in own), sum(r.h for r in own)
                if level == depth or node in cuts:
                    continue
                best = (LEAST_GAIN, "", 0)
                for k in FEATURES:
                    gl = hl = 0.0
                    for r in sorted((r for r in rows if r.leaf == node and r.feature == k), key=lambda r: r.bin):
                        gl, hl = gl + r.g, hl + r.h
                        gr, hr = sums[node][0] - gl, sums[node][1] - hl
                        gain = rounded(gl * gl / (hl + 1) + gr * gr / (hr + 1) - sums[node][0] ** 2 / (sums[node][1] + 1))
                        if gain > best[0]:
                            best = (gain, k, r.bin)
                if best[1]:
                    cuts[node] = best[1:]

        def built(node: int, cuts: dict = cuts, sums: dict = sums) -> list | float:
            if node in cuts and 2 * node + 1 in sums and 2 * node + 2 in sums:
                return [*cuts[node], built(2 * node + 1), built(2 * node + 2)]
            gsum, hsum = sums.get(node, (0.0, 0.0))
            return float(SHRINKAGE * gsum / (hsum + 1))

        grown.append(built(0))
    return start, grown


def fit(candidates: DataFrame) -> tuple[float, list, float]:
    """Start, trees and calibrated threshold from all candidates (features, label)."""
    test = F.pmod(F.xxhash64("m", "before", "after"), F.lit(4)) == 0
    cells = candidates.groupBy(*(f"f_{k}" for k in FEATURES), "label", test.alias("test")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    sample = written(cells, "cells")
    start, grown = boost(sample.where("not test"))
    if not grown:
        return 0.0, [], math.inf
    margin = F.round(sum((tree_value(t) for t in grown), F.lit(start)), 6)
    by = sample.where("test").groupBy(margin.alias("z")).agg(F.sum(F.col("label") * F.col("weight")).alias("pos"), F.sum("weight").alias("n")).collect()  # as many as sums of leaves
    threshold, pos, n = math.inf, 0, 0
    for r in sorted(by, key=lambda r: -r.z):
        pos, n = pos + r.pos, n + r.n
        if pos / n >= PRECISION and n >= 20:
            threshold = r.z
    return start, grown, threshold


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, base and other: arrays of spans (s, k, e, kind, m), sorted."""
    found = written(spans(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    each = written(features(labelled(compared(found))), "candidates")
    start, grown, threshold = fit(each.unionByName(features(disguised(each))))
    if grown and threshold < math.inf:
        margin = F.round(sum((tree_value(t) for t in grown), F.lit(start)), 6)
        span = F.struct("s", F.lit(len(KINDS)).alias("k"), "e", F.lit("other").alias("kind"), "m")
        more = each.where(~F.col("over") & (margin >= threshold)).groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("other"))
    else:
        more = found.select("row", F.lit(None).cast("array<struct<s:int,k:int,e:int,kind:string,m:string>>").alias("other")).where("false")
    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,m:string>>")
    return found.join(more, "row", "left").select("doc_id", "base", F.coalesce("other", empty).alias("other"))


def listed(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "other"))).alias("spans"),
        F.size("other").cast("long").alias("n_other"),
    )
