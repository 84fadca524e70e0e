"""Operator 3, secret scans: counted patterns and a battery of randomness tests.

Base spans come from three patterns. The battery looks at every other run of 20 and more characters
of an encoding's alphabet (hex, base32, base64; the smallest alphabet that holds the run). Under the
null hypothesis the run is text, its characters drawn from the frequencies that the corpus' own runs
of letters have; a secret is drawn evenly. Three tests: chi-squared uniformity over the alphabet, whose
lower tail under the null (noncentral, so it sharpens with length) gives the p-value; a runs test
about the median symbol; the lag-one serial correlation. Runs whose order isn't random (|z| > 3 in the
latter two) keep p = 1. False discoveries are controlled length by length: within a stratum of
encoding and length, candidates pass the Benjamini-Hochberg step at 1 %, on p-values binned upwards,
so that counts of bins, not p-values, are gathered.

Cases: null and empty texts have no spans; an empty table gives no rows; repeated rows are scanned
alike and each counts in the control; very long texts are scanned whole, in linear time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table, written

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Candidates of the battery. Fewer than 20 characters say too little.
RUN, RUN_LEAST = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 20
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
FALSE_RATE, Z_MOST, BINS_A_DECADE = 0.01, 3.0, 20


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """Spans by start, then kind as listed."""
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def outside(runs: Iterable[re.Match], spans: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """Runs, in order, that overlap none of the spans, which are sorted by start; both are walked once."""
    covered: list[list[int]] = []  # the spans' union
    for start, end, _ in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(end, covered[-1][1])
        else:
            covered.append([start, end])
    at = 0
    for m in runs:
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or covered[at][0] >= m.end():
            yield m


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run."""
    has = set(run)
    return next((name for name, chars in ALPHABETS.items() if has <= set(chars)), None)


def text_shares(counts: dict[str, float], alphabet: str) -> np.ndarray:
    """The null hypothesis: shares of an alphabet's characters in running text, a little smoothed."""
    p = np.array([counts.get(c, 0.0) for c in alphabet]) + 1e-9
    return 0.98 * p / p.sum() + 0.02 / len(p)


def p_value(run: str, alphabet: str, shares: np.ndarray) -> float:
    """Of the lower tail of chi-squared against uniformity, if the run were text; 1 if its order isn't random."""
    at = {c: i for i, c in enumerate(alphabet)}
    x = np.array([at[c] for c in run])
    n, k = len(x), len(alphabet)
    seen = np.bincount(x, minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)
    # runs about the median symbol of a uniform draw
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        return 1.0
    expected, spread = 1 + 2 * n0 * n1 / n, math.sqrt(max(1e-9, 2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1))))
    runs = 1 + int((high[1:] != high[:-1]).sum())
    c = x - x.mean()
    serial = float((c[1:] * c[:-1]).sum() / max(1e-9, (c * c).sum())) * math.sqrt(n)
    if abs(runs - expected) > Z_MOST * spread or abs(serial) > Z_MOST:
        return 1.0
    # under the null: mean and variance of the statistic with multinomial shares
    u = 1 / k
    mean = (n - 1) * float((shares**2).sum()) / u - n + 1 / u  # E[sum O^2] k / n - n
    s2, s3 = float((shares**2).sum()), float((shares**3).sum())
    var = max(2.0 * (k - 1) * 0.1, (2 * s2 + 4 * (n - 2) * s3 - (4 * n - 6) * s2 * s2) * (n - 1) * k * k / n)
    return min(1.0, max(1e-300, 0.5 * math.erfc((mean - chi) / math.sqrt(2 * var))))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the ASCII letters, digits and signs of whole texts."""
    total = np.zeros(128, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            if text.as_py():
                total += np.bincount(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8), minlength=256)[:128]
    yield pa.record_batch({"c": pa.array(range(128), pa.int32()), "n": pa.array(total)})


def scan(docs: DataFrame, shares: dict[str, np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base spans, candidates of the battery with stratum and binned p-value."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, cand = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                low = text.lower() if "=" in text or ":" in text else ""
                spans = base_spans(text, low)
                base.append([{"s": s, "e": e, "kind": k} for s, e, k in spans])
                mine = []
                for m in outside(RUN.finditer(text), spans):
                    run = m.group().rstrip("=")
                    kind = encoding(run)
                    if kind:
                        p = p_value(run, ALPHABETS[kind], shares[kind])
                        bin_ = int(-math.log10(p) * BINS_A_DECADE)  # rounds the p-value up
                        mine.append({"s": m.start(), "e": m.end(), "stratum": f"{kind}:{min(9, len(run).bit_length())}", "bin": bin_})
                cand.append(mine)
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, BASE_TYPE), pa.array(cand, CAND_TYPE)], names=["doc_id", "base", "cand"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {kind}, base array<struct<s:int,e:int,kind:string>>, cand array<struct<s:int,e:int,stratum:string,bin:int>>")


BASE_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
CAND_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32())]))


def discoveries(scanned: DataFrame, rate: float = FALSE_RATE) -> dict[str, int]:
    """Least bin that passes the Benjamini-Hochberg step, by stratum; from counts of bins alone."""
    counts = scanned.select(F.explode("cand").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    least: dict[str, int] = {}
    for stratum in {r.stratum for r in counts}:
        own = sorted(((r.bin, r.n) for r in counts if r.stratum == stratum), reverse=True)
        total, so_far = sum(n for _, n in own), 0
        for bin_, n in own:
            so_far += n
            if 10 ** (-bin_ / BINS_A_DECADE) <= rate * so_far / total:
                least[stratum] = bin_
    return least


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and random: arrays of spans (s, e, kind), code points, end exclusive."""
    counts = {chr(r.c): float(r.n) for r in docs.select("text").mapInArrow(_letters, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    scanned = written(scan(docs, {k: text_shares(counts, a) for k, a in ALPHABETS.items()}), "secrets")
    least = discoveries(scanned)

    def ok(c):
        out = F.lit(False)
        for k, v in sorted(least.items()):
            out = out | ((c["stratum"] == k) & (c["bin"] >= v))
        return out

    random = F.transform(F.filter("cand", ok), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit("random").alias("kind")))
    return scanned.select("doc_id", "base", random.alias("random"))


def listed(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    every = F.array_sort(F.transform(F.concat("base", "random"), lambda x: F.struct(x["s"].alias("s"), rank(x).alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
