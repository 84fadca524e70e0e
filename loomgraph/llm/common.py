"""What the training-data operators share: tables, written stages, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where it is unset and one process does it all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = tempfile.mkdtemp(prefix="spark-shared-")
    return f"file://{shared_dir.local}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text) -> F.Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- hashing of whole Arrow batches with numpy -----------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One odd 64-bit number for each byte value, and the base of the polynomial with its inverse mod 2^64.
BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Powers:
    """Powers of BASE and of its inverse, grown as longer inputs come."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 1 << 14)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U64(1)], np.full(m - 1, BASE, dtype=U64)]), dtype=U64)
                self.down = np.cumprod(np.concatenate([[U64(1)], np.full(m - 1, BASE_INV, dtype=U64)]), dtype=U64)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """s with s[j] - s[i] = sum of code(data[k]) * BASE^k over i <= k < j."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(code[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the bytes from start to end (exclusive), the same wherever they stand."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def sliced(batches, rows: int = 1000):
    """Batches of at most `rows` rows, which bounds the arrays that a task makes of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of all texts, and for each text the index of its first word (one more at the end)."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~_BLANK[data]
    begins = word[1:] & ~word[:-1]
    ends = ~word[1:] & word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[word[inner] & word[inner + 1]]  # a word that runs over the edge of two texts
    begins[cut] = True
    ends[cut] = True
    start, end = np.flatnonzero(begins[: len(data) + 1]), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and the index of each text's first word."""
    start, end, first = word_bounds(data, offsets)
    return hashes_between(data, start, end, LOWER_CODE if lower else BYTE_CODE, piece), first


def hashes_between(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """64-bit hash of each stretch of bytes from start to end (exclusive), both ascending."""
    out = np.empty(len(start), dtype=U64)
    at = 0
    while at < len(start):  # pieces keep the powers and sums in cache-sized arrays
        to = max(at + 1, int(np.searchsorted(end, start[at] + piece, side="right")))
        lo = start[at]
        sums = prefix_sums(data[lo : end[to - 1]], code)
        out[at:to] = range_hash(sums, start[at:to] - lo, end[at:to] - lo)
        at = to
    return out


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the least one that it reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# --- connected components --------------------------------------------------------------------------

def contracted(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node long, root long): the smallest node that each node reaches, of nodes whose numbers are hashes.

    Each round gives a node the least of its neighbours, and that one's, in its place and goes on with the links
    that are left between those. Along a chain numbers fall for a few nodes only, unless they are in order, so some rounds of ever fewer rows do.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while not steps or edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        up = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = written(least.join(up, "root").select("node", F.col("up").alias("root")), "roots")
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        edges = written(edges.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        steps.append(step)
    found = steps.pop()
    while steps:
        found = steps.pop().join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(found, "reached")


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node long, root long): the smallest node that each node reaches, whatever the order of the numbers.

    xxhash64 of one long is one-to-one, so the nodes are contracted under their hashes and get their numbers back.
    """
    edges = written(edges.select("a", "b").where("a <> b"), "links")
    found = contracted(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("number")).distinct().withColumn("node", F.xxhash64("number"))
    named = written(nodes.join(found, "node").select("number", "root"), "named")
    least = named.groupBy("root").agg(F.min("number").alias("least"))
    return named.join(least, "root").select(F.col("number").alias("node"), F.col("least").alias("root"))
