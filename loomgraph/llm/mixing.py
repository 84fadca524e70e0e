"""Operator 2, mixing sources to target weights by entropy balancing.

The rates w of a source's documents minimise sum (w log w - w + 1) under 0 <= w <= MOST, such that
sum size * w is the source's target. The dual is convex, one multiplier for each source, and a
document's rate is exponentially tilted by its share of the constraint, w = exp(lambda * size / mean size),
cut off at MOST. Newton steps on the dual take the gradient and the Hessian as sums over all documents,
one distributed groupBy for all sources at once; the table of sources stays a table, and steps that leave
the known bracket of lambda are halved into it. Rounds end as every source is met.

Rates are rounded into whole copies: floor(w), and one more wherever the running sum of the fractions, in
the order of (size, md5(doc_id)), passes a whole number, so that a source's taken words are off by about one
document. The running sums are cut into cells (size, prefix of the md5) of some thousand documents: sums
of cells first, then within cells, so a hot source is spread over many tasks.

Cases: null or blank texts have size 0 and take 0; a null source is a source of its own, the last; an
empty table gives an empty mix; repeated rows are separate documents; a source without words has the
target 0; further columns are left alone by mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import n_words, table, written

#: Weights of the sources in the order of their names, repeating; most copies of a document.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Most Newton steps, and the share of its target by which a source may be off after them.
NEWTON_STEPS, EXACT = 40, 1e-9
ROWS_PER_CELL = 5_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) -> (source, source_size, weight, target): shares by weight, none above most times its size.

    The share of words by weight is raised until the targets add up to all words: sources are ordered
    by the share at which they reach their limit, and the first that doesn't reach it sets the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", weight)
    order = W.orderBy(most * F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below, whole = order.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({
        "free": F.sum("source_size").over(whole) - F.coalesce(F.sum(most * F.col("source_size")).over(below), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)),
    })
    settled = F.col("weight") * F.col("free") <= most * F.col("source_size") * F.col("open")
    level = F.min(F.when(settled, F.struct(most * F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("free"), F.col("open")))).over(whole)
    s = s.withColumn("level", level)
    share = F.col("weight") * F.col("level.free") / F.col("level.open")
    return s.select("source", "source_size", "weight", F.least((most * F.col("source_size")).cast("double"), share).alias("target"))


def _rate(lam: F.Column, x: F.Column, most: int) -> F.Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(50.0))))


def tilted(docs: DataFrame, sources: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """docs(source, size), sources(source, source_size, target) -> sources with mean (size) and lam.

    Sums are gathered by source and size, which is all that they depend on. Where the target is all
    that a source can give, lam is beyond any cut-off.
    """
    sizes = written(docs.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    mean = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    s = sources.alias("s").join(mean.alias("m"), F.expr("s.source <=> m.source"), "left").select("s.*", F.coalesce("m.mean", F.lit(1.0)).alias("mean"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    s = written(s.withColumns({"lam": F.when(full, 1e6).otherwise(0.0), "low": F.lit(-1e9), "high": F.lit(1e9), "met": full | (F.col("target") <= 0)}), "duals")
    for _ in range(steps):
        x, lam = F.col("d.size") / F.col("s.mean"), F.col("s.lam")
        w = _rate(lam, x, most)
        moved = sizes.alias("d").join(s.where("not met").alias("s"), F.expr("d.source <=> s.source")).groupBy("s.source").agg(
            F.sum(F.col("d.size") * F.col("n") * w).alias("words"), F.sum(F.when(w < most, F.col("d.size") * F.col("n") * x * w).otherwise(0.0)).alias("slope"))
        j = s.alias("s").join(moved.alias("m"), F.expr("s.source <=> m.source"), "left")
        off = F.col("m.words") - F.col("s.target")
        done = F.col("s.met") | F.coalesce(F.abs(off) <= EXACT * F.col("s.target"), F.lit(True))
        low, high = F.when(off < 0, F.col("s.lam")).otherwise(F.col("s.low")), F.when(off > 0, F.col("s.lam")).otherwise(F.col("s.high"))
        j = j.select("s.source", "s.source_size", "s.target", "s.mean", "s.lam", low.alias("low"), high.alias("high"), done.alias("met"), (F.col("s.lam") - off / F.greatest(F.col("m.slope"), F.lit(1e-300))).alias("to"))
        inside = (F.col("to") > F.col("low")) & (F.col("to") < F.col("high"))
        # a bracket open on one side is left by a step of one or the double
        half = F.when(F.col("high") >= 1e9, F.greatest(2 * F.col("low"), F.col("low") + 1)).when(F.col("low") <= -1e9, F.least(2 * F.col("high"), F.col("high") - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(inside & (F.abs(F.col("to") - F.col("lam")) < 5), F.col("to")).otherwise(half)
        s = written(j.select("source", "source_size", "target", "mean", F.when(F.col("met"), F.col("lam")).otherwise(step).alias("lam"), "low", "high", "met"), "duals")
        if not s.where("not met").limit(1).count():
            break
    return s


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, rows_per_cell: int = ROWS_PER_CELL, row_id: str = "doc_id", rows: int | None = None) -> DataFrame:
    """docs(row_id, source, size) -> (row_id, source, size, source_size, target, rate, copies)."""
    duals = tilted(docs, targets(docs, weights, most), most)
    rows = docs.count() if rows is None else rows
    digits = max(0, min(8, (max(1, rows // rows_per_cell) - 1).bit_length() + 3 >> 2))
    order = F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    d = docs.select(row_id, "source", "size", order.alias("_order")).withColumn("_cell", F.substring("_order", 1, digits))
    j = d.alias("d").join(duals.alias("s"), F.expr("d.source <=> s.source"))
    rate = F.when((F.col("d.size") == 0) | (F.col("s.target") <= 0), 0.0).otherwise(_rate(F.col("s.lam"), F.col("d.size") / F.col("s.mean"), most))
    # sums of whole millionths are the same in any order
    d = j.select(f"d.{row_id}", "d.source", "d.size", "d._order", "d._cell", "s.source_size", "s.target", F.round(rate, 6).alias("rate"))
    d = d.withColumns({"_whole": F.floor("rate"), "_part": F.round((F.col("rate") - F.floor("rate")) * 1e6).cast("long")})
    cells = d.groupBy("source", "size", "_cell").agg(F.sum("_part").alias("_parts"))
    before = cells.select("source", "size", "_cell", (F.sum("_parts").over(W.partitionBy("source").orderBy("size", "_cell")) - F.col("_parts")).alias("_before"))
    run = F.sum("_part").over(W.partitionBy("source", "size", "_cell").orderBy("_order", row_id).rowsBetween(W.unboundedPreceding, W.currentRow))
    j = d.withColumn("_run", run).alias("d").join(before.alias("c"), F.expr("d.source <=> c.source and d.size = c.size and d._cell = c._cell"))
    upto = F.col("c._before") + F.col("d._run") + 500_000
    one_more = F.floor(upto / 1_000_000) > F.floor((upto - F.col("d._part")) / 1_000_000)
    return j.select(f"d.{row_id}", "d.source", "d.size", "d.source_size", "d.target", "d.rate", F.least(F.lit(most), F.col("d._whole") + one_more.cast("long")).cast("int").alias("copies"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    m = mix(docs)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
