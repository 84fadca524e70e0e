"""Operator 8, quality rules (DataFrame functions only).

Counted rules reject texts that are short or repeat themselves. The others are judged by a
log-likelihood ratio: each word gives one hashed n-gram that takes in its neighbour, the last two characters
of the word before and the word's own first two and last three, and two multinomials over the hash
buckets are counted, of the trusted target (one half of the labelled documents of good quality) and of the
raw corpus (every word of every document). The target is smoothed by the raw distribution, so a bucket that
the target lacks has the same ratio at any size of the corpus. A document's score is the sum of
log p_target / p_raw over its words, divided by its number of words plus SHRINK, so that short texts are
judged with care. One threshold holds for every document: between the mean scores of the other good and of bad labelled
documents, at the same number of standard deviations from both; without bad ones, six deviations below the
good. Every labelled document counts, in the target or for the threshold. Documents that can be of the target meet
their labels as arrays of buckets, two bytes a word, all others as a score, so that no text is shuffled however
many labels there are.

Cases: null, empty and blank texts have 0 words, fail the base and are not kept; an empty table gives
no rows; without labels both multinomials agree, every score is 0 and only the base decides; repeated
rows are judged alike; further columns pass through score() untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

#: Word extraction: the six ASCII blanks as Java writes them.
JAVA_WORD = r"[^\x20\x09-\x0D]+"
#: The smoothing is a share of the target's words; deviations of scores count as LEAST_SPREAD at least.
BUCKETS, SMOOTHING, SHRINK, LEAST_SPREAD = 1 << 15, 0.1, 10.0, 0.1
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(JAVA_WORD), F.lit(0)), F.array().cast("array<string>"))


def bucket(word: Column, before: Column) -> Column:
    """The hashed n-gram of a word and the one before."""
    return F.pmod(F.xxhash64(F.right(F.coalesce(before, F.lit("")), F.lit(2)), F.substring(word, 1, 2), F.substring(word, -3, 3)), F.lit(BUCKETS)).cast("int")


def in_target(doc_id: Column) -> Column:
    """Good labelled documents are the target by half; the others set the threshold."""
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)) == 0


def buckets(words_: str) -> Column:
    """The bucket of each word of a column of words."""
    return F.transform(words_, lambda w, i: bucket(w, F.get(words_, i - 1)))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, b: the buckets of the text's words, as a table."""
    return written(docs.select("doc_id", words(F.col("text")).alias("_w")).select("doc_id", buckets("_w").cast("array<short>").alias("b")), "buckets")


def known(each: DataFrame, labels: DataFrame) -> DataFrame:
    """each(doc_id, ...) -> good, target, ... of every labelled document.

    Labels grow with the documents, so they are merged with them at any size and never sent whole to every task.
    """
    of = labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") == 1).alias("good")).distinct().hint("merge")
    return each.join(of, "doc_id").withColumn("target", F.col("good") & in_target(F.col("doc_id"))).select("good", "target", *(c for c in each.columns if c != "doc_id"))


def log_ratios(packed: DataFrame, labelled: DataFrame) -> list[float]:
    """log p_target / p_raw of each bucket, with additive smoothing; as many numbers as there are buckets."""
    each = packed.select(F.lit(None).cast("int").alias("trusted"), F.lit(1).alias("own"), F.explode("b").alias("b"))
    each = each.unionByName(labelled.where("target").select(F.lit(1).alias("trusted"), F.lit(None).cast("int").alias("own"), F.explode("b").alias("b")))
    counts = each.groupBy("b").agg(F.count("own").alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = sum(r.raw for r in counts), sum(r.target for r in counts)
    out = [0.0] * BUCKETS
    if not target:
        return out
    m = SMOOTHING * target
    for r in counts:
        out[r.b] = math.log((r.target + m * r.raw / raw) / (target + m)) - math.log(r.raw / raw)
    return out


def _covered(ordered: str) -> Column:
    """Words within windows of five words that stand twice or more in the text; ordered: column of (hash, place), sorted.

    A column and not an expression, which the lambda would evaluate anew for each element.
    """
    hash_at = lambda i: F.get(ordered, i)["h"]
    repeated = F.filter(ordered, lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False)))
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
    )["n"]


def llr(buckets_: str, ratios: list[float]) -> Column:
    """The score of a column of buckets."""
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(buckets_, F.lit(0.0), lambda acc, b: acc + F.get(weights, b.cast("int")))
    return F.round(total / (F.size(buckets_) + SHRINK), 9)


def counted(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _b, the buckets of the words."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_w", words(F.col("text")))
    d = d.withColumns({"_n": F.size("_w"), "_b": buckets("_w")})
    # lines with a word, told apart by their text
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_lines", F.when(F.instr(text, "\n") > 0, lines))
    d = d.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    at = lambda i: F.get("_wh", i)
    d = d.withColumn("_windows", F.when(F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*(at(i + k) for k in range(WINDOW))))))
    some_twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    # a column that isn't deterministic keeps filters above from being rewritten in terms of what stands
    # below, which would evaluate the columns that lambdas refer to anew for each of their elements
    fixed = F.spark_partition_id()
    d = d.withColumns({"_ordered": F.when(some_twice, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), "_fixed": fixed})
    d = d.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long"),
        "n_repeat_words": F.when(F.col("_ordered").isNotNull() & (F.col("_fixed") >= 0), _covered("_ordered")).otherwise(F.lit(0)).cast("long"),
        "_fixed": fixed,
    })
    d = d.withColumn("base_failed", (F.col("_fixed") < 0) | (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return d.drop("_w", "_n", "_lines", "_wh", "_windows", "_ordered", "_fixed")


def verdict(counts: DataFrame, ratios: list[float], threshold: float) -> DataFrame:
    """What counted() adds -> with llr and kept, without the buckets."""
    return counts.withColumn("llr", llr("_b", ratios)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).drop("_b")


def score(docs: DataFrame, ratios: list[float], threshold: float = 0.0) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept."""
    return verdict(counted(docs), ratios, threshold)


def threshold(packed: DataFrame, labels: DataFrame, ratios: list[float]) -> float:
    """The score from which on documents are kept, from the scores of all labelled ones outside the target."""
    scored = packed.where("size(b) > 0").select("doc_id", llr("b", ratios).alias("llr"))
    by = known(scored, labels).where("not target").groupBy("good").agg(F.avg("llr").alias("mean"), F.stddev_pop("llr").alias("spread")).collect()
    at = {r.good: (r.mean, max(LEAST_SPREAD, r.spread)) for r in by}
    if True not in at:
        return -math.inf
    (good, wide), (bad, narrow) = at[True], at.get(False, (math.inf, LEAST_SPREAD))
    return round((good * narrow + bad * wide) / (wide + narrow) if bad < good else good - 6 * wide, 6)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts the corpus, sets the threshold, then judges each of the documents."""
    packed = bucketed(docs)
    ratios = log_ratios(packed, known(packed, labels))
    return score(docs, ratios, threshold(packed, labels, ratios))


def judge_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As judge(), without the texts: these are read once, as counts and buckets are written together."""
    counts = counted(docs.select("doc_id", "text")).withColumn("_b", F.col("_b").cast("array<short>")).drop("text")
    counts = written(counts, "counts")
    packed = counts.select("doc_id", F.col("_b").alias("b"))
    ratios = log_ratios(packed, known(packed, labels))
    return verdict(counts, ratios, threshold(packed, labels, ratios))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
