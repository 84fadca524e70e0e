"""Operator 7, sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked (through their group, so a group of m costs m rows, not m^2
edges). Labels start from a hash of doc_id. In each round a linked document wants the label that most
of its group has; moves from one shard to another are admitted up to what comes back the other way
plus the room left under the quota, in the order of a hash. Only linked documents take part in the
rounds; a document without links keeps its label. The law is `rows`: at the end each shard gets n/8
rows, at most one apart; rows beyond a shard's quota, unlinked ones first, fill the shards below it.
Ranks come from running sums over cells (shard, linked, hash cell), so no shard, group or source is
ever sorted in one task.

Cases: null texts are equal to each other, with size 1 and crc 0; an empty table gives no rows;
repeated rows are separate rows of one group and take slots of their own; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

SHARDS, ROUNDS, ROWS_PER_CELL = 8, 3, 5_000
#: Share by which a shard may pass its quota of linked rows while labels move.
SLACK = 0.02


def _label(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("start")), F.lit(shards)).cast("int")


def propagate(linked: DataFrame, quota: dict[int, int], shards: int, rounds: int = ROUNDS) -> DataFrame:
    """linked(doc_id, grp, m, h, label) -> the same rows with labels moved towards those of their groups.

    quota: rows that each shard can take from the linked ones. The table of moves between shards,
    shards^2 rows, is all that reaches the driver.
    """
    for k in range(rounds):
        votes = linked.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
        # ties go to a label that depends on the group, so that no shard is favoured
        best = votes.groupBy("grp").agg(F.max(F.struct("n", F.pmod(F.xxhash64("grp") + F.col("label"), F.lit(shards)).alias("turn"), "label")).alias("best"))
        want = linked.join(best.select("grp", F.col("best.label").alias("want")), "grp")
        flows = {(r.label, r.want): r.n for r in want.groupBy("label", "want").agg(F.count(F.lit(1)).alias("n")).collect()}
        have = {s: sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)}
        asked = {(a, b): n for (a, b), n in flows.items() if a != b}
        if not asked:
            break
        # swaps first, then what fits below the quota
        admit = {ab: min(n, asked.get(ab[::-1], 0)) for ab, n in asked.items()}
        for (a, b), n in sorted(asked.items(), key=lambda x: (-x[1], x[0])):
            room = int(quota[b] * (1 + SLACK)) - have[b]
            more = max(0, min(n - admit[a, b], room))
            admit[a, b] += more
            have[a] -= more
            have[b] += more
        share = F.lit(0.0)
        for (a, b), n in asked.items():
            share = F.when((F.col("label") == a) & (F.col("want") == b), F.lit(admit[a, b] / n)).otherwise(share)
        # a group moves together, its lot drawn by group; where it is large for a shard, each row draws
        large = F.col("m") > sum(quota.values()) // shards // 20
        lot = F.pmod(F.xxhash64(F.when(large, F.hash("h")).otherwise(F.hash("grp")), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
        linked = written(want.withColumn("label", F.when((F.col("label") != F.col("want")) & (lot < share), F.col("want")).otherwise(F.col("label"))).drop("want"), "labels")
    return linked


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, grp, linked, shard, slot; rows at most one apart."""
    key = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")), 256)
    base = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.substring(key, 1, 32)).alias("grp"), F.xxhash64("doc_id").alias("h"), _label(F.col("doc_id"), shards).alias("label"),
    ), "rows")
    n = base.count()
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    groups = base.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    linked = written(base.select("doc_id", "grp", "h", "size", "text_crc32", "label").join(groups, "grp"), "linked")
    moved = propagate(linked, quota, shards, rounds).withColumn("linked", F.lit(True))
    alone = base.join(groups, "grp", "left_anti").withColumns({"m": F.lit(1).cast("long"), "linked": F.lit(False)})
    rows = moved.unionByName(alone.select(*moved.columns))
    return _fill(rows, quota, shards, max(1, n // rows_per_cell // shards))


def _fill(rows: DataFrame, quota: dict[int, int], shards: int, cells: int) -> DataFrame:
    """Gapless slots under the quotas: rows beyond a shard's quota go, in order, to the shards below theirs."""
    order = ["h", "doc_id", "size", "text_crc32"]
    rows = rows.withColumn("cell", F.pmod(F.shiftright("h", 20), F.lit(cells)).cast("int"))
    rows = written(rows.withColumn("nth", F.row_number().over(W.partitionBy("label", "linked", "cell").orderBy(*order)).cast("long") - 1), "ranked")
    counts = rows.groupBy("label", "linked", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("label", "linked", "cell", (F.sum("n").over(W.partitionBy("label").orderBy(F.desc("linked"), "cell")) - F.col("n")).alias("before"))
    have = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rows = rows.join(before, ["label", "linked", "cell"]).withColumn("rank", F.col("before") + F.col("nth"))
    over_at, spill = 0, F.lit(None).cast("long")
    for s in range(shards):  # position among all rows beyond a quota
        extra = max(0, have.get(s, 0) - quota[s])
        if extra:
            spill = F.when((F.col("label") == s) & (F.col("rank") >= quota[s]), F.col("rank") - quota[s] + over_at).otherwise(spill)
        over_at += extra
    rows = rows.withColumn("spill", spill)
    to, slot, at = F.col("label"), F.col("rank"), 0
    for s in range(shards):
        gap = max(0, quota[s] - have.get(s, 0))
        if gap:
            here = F.col("spill").isNotNull() & (F.col("spill") >= at) & (F.col("spill") < at + gap)
            to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("spill") - at + have.get(s, 0)).otherwise(slot)
        at += gap
    return rows.select("doc_id", "size", "text_crc32", F.hex("grp").alias("grp"), "linked", to.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shard(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
