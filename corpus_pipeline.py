"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), docs having at least the columns of `documents`, and works on
all that the stage before it kept; run() writes each stage's rows as Parquet and reads them again.
All stages but the last return the columns they were given; the last returns the assignment to shards,
a row for each copy. Null texts fall to the quality rules; rows without a doc_id are never grouped
with others; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from loomgraph.llm.common import n_words, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    judged = quality_rules.judge(packed, table(spark, sf_dir, "labels"))
    return judged.where("kept").select("_row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of linked documents; equal rows of it once.

    Near duplicates share 80 percent of their five-word shingles; op1's three words and 90 percent are its own contract.
    """
    groups = ngram_join.join(docs, size=5, percent=80).select("doc_id", "component_id").distinct()
    stays = groups.where("doc_id = component_id").select("doc_id")
    packed = docs.select(F.struct(*docs.columns).alias("_row")).join(stays.select(F.col("doc_id").alias("_stays")), F.expr("_row.doc_id = _stays"), "left_semi")
    # repeated rows of a document are one; a row that shares its doc_id with another text is not lost
    once = packed.distinct().unionByName(docs.where("doc_id is null").select(F.struct(*docs.columns).alias("_row")))
    return once.select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    clashes = {c: f"{c}_of_docs" for c in docs.columns if c in ("bench_items", "bench_similarity")}
    found = decontamination.search_benchmark(docs.withColumnsRenamed(clashes), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("bench_items") == 0).withColumns({c: F.col(as_) for c, as_ in clashes.items()}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share a doc_id share the number."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    copies = mixing.mix(sizes).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    taken = docs.select(F.struct(*docs.columns).alias("_row")).join(copies, F.expr("_row.doc_id <=> _id"))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each copy."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "linked", "shard", "slot")


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Hashing, Newton steps and label propagation are not for SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
