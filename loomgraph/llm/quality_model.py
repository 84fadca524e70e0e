"""Operator 6, quality classifier: a convolutional network over bytes, in numpy.

The bytes of a whole text are cut into overlapping chunks of CHUNK positions. A filter adds one learned
number for each of WIDTH bytes in a row; its response, cut off below zero, is max-pooled over the chunk.
The document's maximum and mean of its chunks' pools go through one logistic unit. Filters and unit are
learned together by Adam on at most TRAIN_MOST labelled documents of each class (those with the least
hash of doc_id) and at most TRAIN_CHUNKS evenly spaced chunks of each; every document is scored over
all of its chunks. Rows whose crc32(doc_id) mod 3 is 1 are held out of the learning.

Cases: null and empty texts count as one chunk of padding and get a score; without labels of both
classes every score is the share of label 1 among those seen (0.5 without any); an empty table gives no
rows; repeated rows score alike; the text alone enters a score, so further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, utf8

FILTERS, WIDTH, CHUNK = 16, 6, 1024
TRAIN_MOST, TRAIN_CHUNKS, EPOCHS, BATCH, LEAST_STEPS, RATE = 600, 3, 6, 32, 150, 0.02


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def pieces(data: np.ndarray, most: int | None = None) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 bytes that cover the text, neighbours overlapping by WIDTH - 1; padded with 0."""
    n = max(1, -(-(len(data) - WIDTH + 1) // CHUNK))
    padded = np.zeros(n * CHUNK + WIDTH - 1, dtype=np.uint8)
    padded[: len(data)] = data[: len(padded)]
    at = np.arange(n) if most is None or n <= most else np.linspace(0, n - 1, most).astype(int)
    return padded[(at * CHUNK)[:, None] + np.arange(CHUNK + WIDTH - 1)]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "table": r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "shift": np.zeros(FILTERS, np.float32),
            "unit": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32),
        }
        self.prior = 0.0

    def pool(self, chunks: np.ndarray, where: bool = False):
        """Max-pooled responses of each chunk, one row each; with where, also the places of the maxima."""
        z = self.p["table"][0][chunks[:, :CHUNK]]
        for k in range(1, WIDTH):
            z += self.p["table"][k][chunks[:, k : k + CHUNK]]
        m = np.maximum(z.max(axis=1) + self.p["shift"], 0)
        return (m, z.argmax(axis=1)) if where else m

    def features(self, pools: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maximum and mean of each document's chunks; first: index of its first chunk."""
        counts = np.diff(np.append(first, len(pools)))
        return np.hstack([np.maximum.reduceat(pools, first), np.add.reduceat(pools, first) / counts[:, None]])

    def scores(self, features: np.ndarray) -> np.ndarray:
        logit = features.astype(np.float64) @ self.p["unit"] + self.p["bias"][0] + self.prior
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        mean, square, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(docs))))
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                chunks = np.concatenate([docs[i] for i in own])
                counts = np.array([len(docs[i]) for i in own])
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                pools, at = self.pool(chunks, where=True)
                f = self.features(pools, first)
                logit = f @ self.p["unit"] + self.p["bias"][0]
                err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels[own]).astype(np.float32) / len(own)
                g = {"unit": f.T @ err + 1e-4 * self.p["unit"], "bias": np.array([err.sum()], np.float32)}
                back = err[:, None] * self.p["unit"]
                doc = np.repeat(np.arange(len(own)), counts)
                to_max = back[:, :FILTERS][doc] * (pools == np.repeat(f[:, :FILTERS], counts, axis=0))
                d = (to_max + back[:, FILTERS:][doc] / counts[doc][:, None]) * (pools > 0)
                g["shift"] = d.sum(axis=0)
                g["table"] = np.zeros_like(self.p["table"])
                rows, filters = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
                for k in range(WIDTH):
                    np.add.at(g["table"][k], (chunks[rows, at + k], np.broadcast_to(filters, at.shape)), d)
                step += 1
                rate = RATE * (1 - 0.8 * epoch / epochs)
                for key, grad in g.items():
                    mean[key] = 0.9 * mean[key] + 0.1 * grad
                    square[key] = 0.99 * square[key] + 0.01 * grad * grad
                    self.p[key] -= rate * (mean[key] / (1 - 0.9**step)) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-7)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        yield pa.record_batch({"label": batch.column("label"), "n": pa.array([len(pieces(data[a:b], TRAIN_CHUNKS)) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int32()), "chunks": pa.array([pieces(data[a:b], TRAIN_CHUNKS).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_MOST) -> Network:
    """Learns from at most `most` documents of each class; labels(doc_id, quality), held-out rows left out."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    net = Network()
    if len(shares) < 2:
        total = sum(shares.values())
        net.p["unit"][:] = 0
        net.prior = float(np.log((shares.get(1, 0) + 0.5) / (total - shares.get(1, 0) + 0.5)))
        return net
    picks = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    ids = F.broadcast(picks[0].union(picks[1]))  # at most 2 * most rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(_sample, "label int, n int, chunks binary").collect()
    rows.sort(key=lambda r: (r.label, r.chunks))
    net.learn([np.frombuffer(r.chunks, np.uint8).reshape(r.n, -1) for r in rows], np.array([r.label for r in rows], np.float32))
    net.prior = float(np.log(shares[1] / shares[0]) - np.log(max(1, sum(r.label for r in rows)) / max(1, sum(1 - r.label for r in rows))))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Adds score and predicted; every byte of every text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            pools, first, held, rows, n = [], [], [], 0, 0
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = pieces(data[a:b])
                first.append(n)
                n += len(own)
                for k in range(0, len(own), 16):  # pieces in groups whose responses fit the cache
                    held.append(own[k : k + 16])
                    rows += len(held[-1])
                    if rows >= 16:
                        pools.append(net.pool(np.concatenate(held)))
                        held, rows = [], 0
            if held:
                pools.append(net.pool(np.concatenate(held)))
            s = np.round(net.scores(net.features(np.concatenate(pools), np.array(first))), 6) if first else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.mapInArrow(run, schema)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
