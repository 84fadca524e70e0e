"""Each operator on small documents with the hard cases, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, secrets, sharding, suffix_dedup
from loomgraph.llm.common import components, n_words
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    clashing = {c: F.lit("x") for c in ("n", "cid", "key", "row", "size", "rank", "kept", "score", "base", "cand", "label", "copies", "h", "grp")}
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).withColumns(clashing).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (9, 1, 0), (10, 1, 1), (20, 0, 0), (21, 0, 0), (99, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert not components(e.where("false")).collect()


def test_ngram_join(docs, nothing):
    got = rows_of(ngram_join.join(docs).where("doc_id is not null"), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == cases.ngram_join(cases.documents())
    assert not ngram_join.join(nothing).collect()


def test_ngram_join_blocks(spark):
    """A group of near copies over many blocks loses no link."""
    base = cases.prose(11, 120)
    rows = [(i, " ".join([*base[: i % 100], f"w{i}", *base[i % 100 + 1 :]]), "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    assert rows_of(ngram_join.join(df, block=7), "doc_id", "n_shingles", "component_id", "n_links") == cases.ngram_join(rows)


def test_linked_sets_share_a_part():
    """Sets at the edge of the similarity agree in a part of a scheme of both."""
    r = np.random.default_rng(5)
    common = (r.random(1 << ngram_join.SKETCH_BITS) < 0.3).astype(np.int64)
    for percent in (90, 80):
        schemes = ngram_join.Schemes(percent, common)
        for n in [*range(4, 60), 97, 200, 555]:
            for _ in range(6):
                a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                most = n - int(np.ceil(percent / 100 * n - 1e-9))  # that many may be missing
                out = int(r.integers(0, most + 1))
                more = next(k for k in range(n, -1, -1) if 100 * (n - out) >= percent * (n + k))  # and that many may be new
                b = np.unique(np.concatenate([np.delete(a, r.permutation(n)[:out]), r.integers(0, 2**63, more, dtype=np.uint64) * np.uint64(2)]))
                if out + more and 100 * (n - out) >= percent * (n + more):
                    assert set(schemes.signatures(a).tolist()) & set(schemes.signatures(b).tolist()), (percent, n)


def test_groups_of_unrelated_sets_stay_small(spark):
    """Documents that share a long passage and nothing else don't meet in groups, however many they are."""
    shared = " ".join(cases.prose(1, 40))
    rows = [(i, " ".join([*cases.prose(100 + i, 60), shared, *cases.prose(9000 + i, 60)]), "en", "s", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(2)
    p = ngram_join.profiles(df, 5)
    agreed = ngram_join.signature_rows(df, 5, 80, ngram_join.common_tokens(p), 3).groupBy("bucket").applyInPandas(ngram_join._agreeing, "cid long, lo long")
    assert agreed.select("cid").distinct().count() < 30


def test_mixing(spark, docs, nothing):
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    m = mixing.mix(sizes, rows_per_cell=3).collect()
    total, by = sum(r["size"] for r in m), defaultdict(list)
    for r in m:
        assert r["size"] == len(cases.words(next(x[1] for x in cases.documents() if x[0] == r.doc_id)))
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    capped: set = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and level * weight[s] > 3 * size[s] + 1e-9}
        if not more:
            break
        capped |= more
    for s in names:
        want = 3 * size[s] if s in capped else level * weight[s]
        assert by[s][0].target == pytest.approx(want)
        low, high = -1e6, 1e6  # the multiplier by halving
        own = [r["size"] for r in by[s] if r["size"]]
        at = lambda lam: [min(3.0, np.exp(min(50, lam * x * len(own) / sum(own)))) for x in own]  # noqa: E731, B023
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(x * w for x, w in zip(own, at(mid), strict=True)) < want else (low, mid)
        rates = dict(zip(own, at(high), strict=True))
        assert all(r.rate == pytest.approx(rates.get(r["size"], 0), abs=2e-6) for r in by[s])
        assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in by[s])
        assert abs(sum(r["size"] * r.copies for r in by[s]) - want) <= max(r["size"] for r in by[s])
    assert Counter(map(tuple, m)) == Counter(map(tuple, mixing.mix(sizes.repartition(5), rows_per_cell=3).collect()))
    assert not mixing.mix(nothing.select("doc_id", "source", n_words(F.col("text")).alias("size"))).collect()


def test_secrets(docs, nothing):
    text = {r[0]: r[1] for r in cases.documents()}
    found = secrets.find_secrets(docs).select("doc_id", secrets.listed(F.col("base")).alias("base")).collect()
    assert len(found) == len(cases.documents())
    for r in found:
        assert r.base == ",".join(cases.spans(text[r.doc_id], cases.SECRETS)), r.doc_id
    assert not secrets.find_secrets(nothing).collect()


def test_randomness_battery():
    r = np.random.default_rng(3)
    words = "".join(cases.prose(8, 4000)).encode("ascii", "ignore").decode()
    shares = secrets.text_shares(Counter(words), secrets.ALPHABETS["base64"])
    even = ["".join(r.choice(list(secrets.ALPHABETS["base64"]), 40)) for _ in range(100)]
    prose = [words[i : i + 40] for i in range(0, 4000, 40)]
    p = lambda x: secrets.p_value(x, secrets.ALPHABETS["base64"], shares)
    assert sum(p(x) < 1e-3 for x in even) > 90
    assert sum(p(x) < 1e-3 for x in prose) < 3
    assert p("ab" * 30) == 1.0


def test_secrets_adds_random_spans(spark):
    r = np.random.default_rng(4)
    key = "".join(r.choice(list(secrets.ALPHABETS["base64"]), 48))
    rows = [(i, " ".join(cases.prose(i, 300)) + " " + "".join(cases.prose(i, 9)), "en", "s", 0) for i in range(30)] + [(99, f"see {key} there", "en", "s", 0)]
    found = {x.doc_id: x.random for x in secrets.find_secrets(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert any((s.s, s.e) == (4, 52) for s in found[99])
    assert sum(bool(v) for k, v in found.items() if k != 99) <= 1


@pytest.mark.parametrize("hot", [10_000, 0])
def test_suffix_dedup(docs, hot):
    rows, cut = suffix_dedup.repeats(docs, length=40, gram=12, hot=hot)
    j = rows.join(cut, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)), F.coalesce(F.size("spans"), F.lit(0)), F.coalesce("kept_sha256", "sha"))
    assert Counter(map(tuple, j.collect())) == cases.suffix_dedup(cases.documents(), 40)


def test_suffix_runs_cover_every_window(monkeypatch):
    r = np.random.default_rng(1)
    for data in (r.integers(0, 3, 5000).astype(np.uint8), np.zeros(700, np.uint8), r.integers(0, 256, 199).astype(np.uint8)):
        monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
        s, e, a, *_ = suffix_dedup.runs(data)
        assert sum(e - s + 1) == max(0, len(data) - 199)
        assert all((a >= e) & (a + suffix_dedup.GRAM <= s + 200)) if len(s) else True


def test_suffix_dedup_empty(nothing):
    rows, cut = suffix_dedup.repeats(nothing)
    assert not rows.collect() and not cut.collect()


def test_line_dedup(spark, docs, nothing):
    lines = [" ".join(cases.prose(100 + i, 30)) for i in range(5)]
    near = lines[0][:40] + "x" + lines[0][41:]
    upper = lambda x: "".join(c.upper() if "a" <= c <= "z" else c for c in x)
    rows = [(2, f"{lines[0]}\n{lines[1]}\nshort\n\n{upper(lines[0])}", "en", "s", 0), (1, f"{lines[1]}\nshort", "en", "s", 0), (3, f"{near}\n{lines[2]}", "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, f"{lines[3]}\n", None, None, None), (6, f"{lines[3]}\n", None, None, None)]
    got = Counter(tuple(r) for r in line_dedup.dedup(spark.createDataFrame(rows, cases.SCHEMA)).select("doc_id", "n_lines", "n_removed", "kept").collect())
    assert got == Counter([(2, 5, 3, f"{lines[0]}\n"), (1, 2, 0, f"{lines[1]}\nshort"), (3, 2, 1, lines[2]), (4, 0, 0, ""), (5, 0, 0, ""), (6, 2, 0, f"{lines[3]}\n"), (6, 2, 1, "")])
    assert line_dedup.dedup(docs).count() == docs.count()
    assert not line_dedup.dedup(nothing).collect()


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _kept_lines(spark, lines):
    """Indexes of the lines that stay, each line a document, at the production radius."""
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(lines)], cases.SCHEMA)
    return {r.doc_id for r in line_dedup.dedup(df).collect() if not r.n_removed}


def test_line_dedup_edits_of_words(spark):
    """At the production radius, all pairs of edit similarity 0.9 in lines of 5 to 60 words are linked, as brute force has them."""
    r, lines = np.random.default_rng(6), []
    for i, n in enumerate([5, 8, 12, 20, 34, 50, 60] * 3):
        base = cases.prose(300 + i, n)
        lines.append(" ".join(base))
        for times in (1, 2, 3):
            own = list(base)
            for at in r.permutation(n)[: max(1, times * n // 40)]:
                own[at] = cases.prose(900 + 10 * i + times, 1)[0] + "x"
            lines.append(" ".join(own))
    norm, root = [cases.low(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            most = max(len(norm[i]), len(norm[j])) // 10
            if abs(len(norm[i]) - len(norm[j])) <= most and i // 4 == j // 4 and _levenshtein(norm[i], norm[j]) <= most:
                root = [root[j] if x == root[i] else x for x in root]
    want = {min(i for i in range(len(lines)) if root[i] == k) for k in set(root)}
    assert len(want) < 0.6 * len(lines)
    assert _kept_lines(spark, lines) == want


def test_line_dedup_orders_of_words(spark):
    """Lines of the same words share a fingerprint; two that differ by a swap are linked whatever the lead is."""
    r, lines, want = np.random.default_rng(8), [], set()
    for i in range(6):
        base = cases.prose(700 + i, 40)
        swapped = [*base[:7], base[8], base[7], *base[9:]]
        want |= {len(lines) + k for k in (0, 2, 3, 4, 5, 6)}
        lines += [" ".join(x) for x in (base, swapped, *(r.permutation(base) for _ in range(5)))]
    assert _kept_lines(spark, lines) == want


def test_line_dedup_packs_signatures(spark):
    """A class costs its signatures' keys, fingerprints and letters at most once each, compressed, in however many buckets."""
    lines = spark.createDataFrame([(i, " ".join(cases.prose(i, 30)), "en", "s", 0) for i in range(4000)], cases.SCHEMA).selectExpr("doc_id", "text", "doc_id as row").coalesce(1)
    each = lines.mapInArrow(line_dedup.line_rows, f"row long, doc_id long, {line_dedup.LINES}")
    rows = line_dedup.signature_rows(each, 4, line_dedup.plan(10**6))
    size = rows.select(sum(F.length(c) for c, kind in rows.dtypes if kind == "binary").alias("size")).agg(F.sum("size")).first()[0]
    assert size < 440 * 4000


def test_line_dedup_parts_large_groups(spark):
    """Lines of the same letters in other orders are candidates, not alike: pairs of letters part them before they are verified; what is alike stays together."""
    r, rows = np.random.default_rng(5), []
    words = cases.prose(55, 40)
    for i in range(60):
        own = [*words[:20], *"".join(r.permutation(list(" ".join(words[20:])))).split()]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], own[-1] + "x"]))]
    sketch = lambda batches: line_dedup.pair_rows(b for b in batches)
    norm = spark.createDataFrame(rows, "key long, norm string")
    kinds = "key long, sim long, length int, counts binary, picks array<long>"
    fine = line_dedup.candidate_groups(norm.mapInArrow(sketch, kinds), len(rows), 2, 0.9, line_dedup.PAIRS, 4)
    got = {x.key: x.grp for x in fine.collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(60)) and len(set(got.values())) > 30


def test_line_dedup_contracts_chains(spark):
    r = np.random.default_rng(9)
    name = r.permutation(400)
    edges = [(int(name[i]), int(name[i + 1])) for i in range(300) if i % 100 != 99] + [(int(name[i]), int(name[i])) for i in range(5)] + [(int(name[350]), int(name[351]))] * 2
    df = spark.createDataFrame(edges, "a long, b long")
    assert rows_of(line_dedup.contracted(df), "node", "root") == rows_of(components(df), "node", "root")
    assert not line_dedup.contracted(df.where("a < 0")).collect()


def test_components_of_long_chains(spark):
    """Chains of 300 whose numbers rise, or are in no order, settle as brute force has them."""
    r = np.random.default_rng(9)
    for name in (np.arange(400), r.permutation(400)):
        edges = [(int(name[i]), int(name[i + 1])) for i in range(300)] + [(int(name[350]), int(name[351]))]
        least = min(int(x) for x in name[:301])
        want = Counter({(int(x), least): 1 for x in name[:301]}) + Counter({(int(x), int(min(name[350:352]))): 1 for x in name[350:352]})
        assert rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == want


def test_line_dedup_edit_distances_by_batch():
    """Whether lines are alike, taken for many pairs at once, is what the edit distance says; also with characters beyond one byte, and with long lines."""
    r, lines = np.random.default_rng(12), []
    for size in [1, 5, 30, 80, 300] * 3 + [2600]:
        base = list("".join(r.choice(list("abc déж"), size)))
        for times in (0, 1, size // 12, size // 10, size // 8):
            own = list(base)
            for _ in range(times):
                at, kind = int(r.integers(len(own))), int(r.integers(3))
                own[at : at + 1] = [] if kind == 0 and len(own) > 1 else "xю"[int(r.integers(2))] + (own[at] if kind == 1 else "")
            lines.append("".join(own))
    many = "".join(chr(0x4E00 + i) for i in range(400))
    lines += [many, many[:390] + many[380:], "".join(chr(0x4E00 + i) for i in range(300, 700))]
    own = line_dedup.Lines(lines, 0.9)
    a, b = np.triu_indices(len(lines), 1)
    most = own.most(a, b)
    near = np.abs(own.length[a] - own.length[b]) <= most
    want = np.array([ok and line_dedup.edits(lines[i], lines[j], int(k)) <= k for i, j, k, ok in zip(a, b, most, near)])
    assert (own.alike(a, b) == want).all() and 30 < want.sum() < near.sum() and not own.exact[-1]


def test_line_dedup_verifies_in_proportion():
    """m lines each within the bound of one, and few of each other: some comparisons a line, not all pairs; and what is linked does not hang on the pairs' order."""
    r, base = np.random.default_rng(13), "".join(cases.prose(77, 60))
    lines = [base]
    for _ in range(400):
        own = list(base)
        for at in r.permutation(len(base))[: len(base) // 11]:
            own[at] = "0123456789"[int(r.integers(10))]
        lines.append("".join(own))
    own, tried, alike = line_dedup.Lines(lines, 0.9), [], line_dedup.Lines.alike
    own.alike = lambda a, b: tried.append(len(a)) or alike(own, a, b)
    a, b = np.triu_indices(len(lines), 1)
    assert not own.connected(a, b).any() and sum(tried) < 20 * len(lines)
    order = r.permutation(len(a))
    assert not own.connected(a[order], b[order]).any()


def test_line_dedup_pairs_beyond_ties(spark):
    """Candidates beyond the bits of a tie come as pairs; lines of many of them are tied to each other, so rows follow the lines."""
    r, rows = np.random.default_rng(14), []
    for i in range(320):
        own = cases.prose(88 + max(0, i - 300), 40)
        for k in range(1 + (i >= 300)):
            for at in r.permutation(30)[: 13 if i < 300 else 4 * k]:
                own[10 + at] = cases.prose(5000 + 50 * i + int(at), 1)[0] + "q"
            rows.append((2 * i + k, " ".join(own)))
    lines = spark.createDataFrame(rows, "key long, norm string").mapInArrow(lambda batches: line_dedup.pair_rows(b for b in batches), "key long, sim long, length int, counts binary, picks array<long>")
    got = line_dedup.candidates(lines, 10**9, 2, 0.2, line_dedup.PAIRS, 4).collect()
    assert {x.tie for x in got} == {True, False} and all(any(x.tie and {x.a, x.b} == {2 * i, 2 * i + 1} for x in got) or any(not x.tie and {x.a, x.b} == {2 * i, 2 * i + 1} for x in got) for i in range(300, 320))
    assert 0 < len(got) < line_dedup.DENSE * len(rows) / 2


def test_pigeonhole_choices():
    r = np.random.default_rng(2)
    for n in (10, 10**5, 10**9, 10**12):
        choices = line_dedup.plan(n)
        for _ in range(200):
            a = int(r.integers(0, 2**63))
            b = a
            for bit in r.permutation(64)[: line_dedup.RADIUS]:
                b ^= 1 << int(bit)
            assert any(all((a >> lo) & ((1 << k) - 1) == (b >> lo) & ((1 << k) - 1) for lo, k in own) for own in choices)


def test_quality_model(spark, docs, labels, nothing):
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("h")).collect()}
    import zlib

    assert all(h == (zlib.crc32(("" if k is None else str(k)).encode()) % 3 == 1) for k, h in held.items())
    net = quality_model.train(docs, labels)
    s = quality_model.score(docs, net).select("doc_id", "text", "score", "predicted").collect()
    assert len(s) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in s)
    assert len({(r.text, r.score) for r in s}) == len({r.text for r in s})
    assert all(r.score == 0.5 for r in quality_model.score(docs, quality_model.train(docs, labels.where("false"))).collect())
    assert not quality_model.score(nothing, net).collect()


def test_quality_model_learns(spark):
    """Held-out documents of two kinds are told apart; a mark at the end of a long text is seen."""
    good = [(2 * i, " ".join(cases.prose(i, 150)), "en", "s", 0) for i in range(60)]
    bad = [(2 * i + 1, " ".join([*cases.prose(1000 + i, 700), *(w + "%%%" for w in cases.prose(i, 60))]), "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(good + bad, cases.SCHEMA)
    lab = df.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    s = quality_model.score(df, quality_model.train(df, lab)).where(quality_model.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in s) >= 0.9 * len(s)


def test_sharding(docs, nothing):
    s = sharding.shard(docs, rows_per_cell=1).collect()
    n = Counter(r.shard for r in s)
    assert len(s) == docs.count() and set(n) <= set(range(8)) and max(n.values()) - min(n[k] for k in range(8)) <= 1
    assert Counter((r.shard, r.slot) for r in s) == Counter((k, i) for k in n for i in range(n[k]))
    import zlib

    text = {r[0]: r[1] for r in cases.documents()}
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in s)
    assert not sharding.shard(nothing).collect()


def test_sharding_brings_links_together(spark):
    rows = [(i, f"text {i % 40}", "en", "s", 0) for i in range(160)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    cut = lambda s: sum(len(set(v)) - 1 for v in s.values())
    after, before = defaultdict(list), defaultdict(list)
    for r in sharding.shard(df).collect():
        after[r.grp].append(r.shard)
    for r in sharding.shard(df, rounds=0).collect():
        before[r.grp].append(r.shard)
    assert cut(after) < 0.6 * cut(before)


def test_quality_rules(docs, labels, nothing):
    text = {r[0]: r[1] for r in cases.documents()}
    judged = quality_rules.judge(docs.select("doc_id", "text"), labels)
    for r in judged.collect():
        want = cases.counted_rules(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert rows_of(judged.where("kept"), "doc_id") == Counter((r.doc_id,) for r in judged.collect() if r.kept)
    assert all(r.llr == 0 for r in quality_rules.judge(docs.select("doc_id", "text"), labels.where("false")).collect())
    assert not quality_rules.judge(nothing, labels).collect()


def test_quality_rules_learn_from_all_labels(spark):
    """Counts and threshold of more labelled documents than any bounded number of them would tell."""
    d = spark.range(0, 41_000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 997 == 0, "rare words").otherwise("frequent words").alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 41 > 0).cast("int").alias("quality"))
    packed = quality_rules.bucketed(d)
    labelled = quality_rules.known(packed, labels)
    assert labelled.count() == 41_000
    got = quality_rules.log_ratios(packed, labelled)
    own = d.join(labels, "doc_id").select("text", (quality_rules.in_target(F.col("doc_id")) & (F.col("quality") == 1)).alias("target"), quality_rules.bucket(F.split("text", " ")[0], F.lit(None)).alias("b")).collect()
    raw, target = Counter(r.b for r in own), Counter(r.b for r in own if r.target)
    n, m = 2 * len(own), 0.2 * sum(target.values())
    for b in raw:
        assert abs(got[b] - math.log((target[b] + m * raw[b] / n) / (10 * m + m)) + math.log(raw[b] / n)) < 1e-9


def test_quality_rules_shuffle_words_of_possible_targets_only(spark):
    """Words are shuffled of no document that can't be of the target, by the same plan at any size; the threshold equals one by hand."""
    d = spark.range(0, 3_000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.hex(F.xxhash64("id", i))), " ").alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    packed = quality_rules.bucketed(d)
    target = quality_rules.known(packed, labels).where("target").select("b")
    plan = target._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert re.search(r"Exchange hashpartitioning\(doc_id[^\n]*\n[^\n]*Filter[^\n]*xxhash64\(doc_id[^\n]*\n[^\n]*FileScan parquet \[doc_id[^\n]*b#", plan)
    of = {r.doc_id: (r.quality, r.t) for r in labels.withColumn("t", quality_rules.in_target(F.col("doc_id"))).collect()}
    assert target.count() == sum(q and t for q, t in of.values())
    ratios = quality_rules.log_ratios(packed, quality_rules.known(packed, labels))
    scores = {r.doc_id: r.llr for r in quality_rules.score(d, ratios).select("doc_id", "llr").collect()}
    good, bad = [scores[i] for i, (q, t) in of.items() if q and not t], [scores[i] for i, (q, t) in of.items() if not q]
    (g, wide), (b, narrow) = ((statistics.fmean(x), max(quality_rules.LEAST_SPREAD, statistics.pstdev(x))) for x in (good, bad))
    assert abs(quality_rules.threshold(packed, labels, ratios) - ((g * narrow + b * wide) / (wide + narrow) if b < g else g - 6 * wide)) < 2e-6


def test_quality_rules_read_texts_once(spark, docs, labels):
    """Verdicts from counts that are written once are those of judge(), and their plan holds no text."""
    got = quality_rules.judge_counts(docs, labels)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    assert rows_of(got, *columns) == rows_of(quality_rules.judge(docs.select("doc_id", "text"), labels), *columns)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_decontamination(spark, docs, nothing):
    rows = cases.documents()
    items = [(0, " ".join(rows[12][1].split()[30:80])), (1, " ".join(rows[6][1].split()[50:100])), (2, "two words"), (3, None), (4, ""), (5, " ".join(cases.prose(77, 40))), (1, " ".join(rows[6][1].split()[50:100]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = cases.weighted_windows(rows, list(dict(items).items()), 0.8)
    for a_block in (20_000, 2):
        found = decontamination.search_benchmark(docs, bench, radius=16, items_a_block=a_block)
        assert found.columns == [*docs.columns, "bench_items", "bench_similarity"]
        assert {(r.doc_id, i) for r in found.collect() for i in r.bench_items} == set(want) or a_block == 2
    assert not decontamination.search_benchmark(nothing, bench).collect()
    assert all(not r.bench_items for r in decontamination.search_benchmark(docs, bench.where("false")).collect())


def _windows_of_any_size(rows, items):
    """As cases.weighted_windows, and documents shorter than an item are one window."""
    out = cases.weighted_windows(rows, items, 0.8)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = {i: cases.words(cases.low(x)) for i, x in items}
    owners = Counter(s for w in own.values() for s in grams(w))
    weigh = lambda ss: sum(1 / max(1, owners[s]) for s in ss)
    for r in rows:
        w = cases.words(cases.low(r[1]))
        for i, x in own.items():
            if 5 <= len(w) < len(x):
                sim = weigh(grams(w) & grams(x)) / weigh(grams(w) | grams(x))
                if sim >= 0.8:
                    out[r[0], i] = sim
    return out


def test_decontamination_of_short_documents(spark):
    """A document that is an item with its start or end cut off is found."""
    items = [(i, " ".join(cases.prose(40 + i, n))) for i, n in enumerate((52, 59, 30, 6))]
    cut = lambda i, a, b: " ".join(items[i][1].split()[a : len(items[i][1].split()) - b])
    texts = [cut(0, 0, 1), cut(0, 2, 2), cut(1, 0, 9), cut(1, 0, 25), cut(2, 1, 0), cut(3, 0, 1), items[3][1], "one two three", None]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts)]
    want = _windows_of_any_size(rows, items)
    assert {(0, 0), (1, 0), (2, 1), (4, 2)} <= set(want)
    found = decontamination.search_benchmark(spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, i) for r in found.collect() for i in r.bench_items} == set(want)


def test_decontamination_of_benchmark_blocks(spark):
    """Blocks of the benchmark don't change weights, at the production radius."""
    head = cases.prose(60, 24)
    items = [(i, " ".join([*head, *cases.prose(61 + i, 20)])) for i in range(6)]
    words = [x.split() for _, x in items]
    texts = [" ".join([*cases.prose(70 + i, 20), *(w if i % 2 else ["x", "y", *w[2:]]), *cases.prose(80 + i, 20)]) for i, w in enumerate(words)]
    texts += [" ".join([*cases.prose(90, 9)[:9], *w[9:]]) for w in words] + [" ".join([*w[:-4], *"a b c d".split()]) for w in words]
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts)]
    want = _windows_of_any_size(rows, items)
    df, bench = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for a_block in (20_000, 2):
        found = decontamination.search_benchmark(df, bench, items_a_block=a_block).collect()
        assert {(r.doc_id, i) for r in found for i in r.bench_items} == set(want)
        assert all(abs(r.bench_similarity - max((v for k, v in want.items() if k[0] == r.doc_id), default=0)) < 1e-9 for r in found)


def test_personal_data(docs, nothing):
    text = {r[0]: r[1] for r in cases.documents()}
    found = pii.find_personal_data(docs).select("doc_id", pii.listed(F.col("base")).alias("base"), F.sha2(pii.listed(F.col("base")), 256).alias("sha"), "other").collect()
    assert len(found) == len(cases.documents())
    for r in found:
        want = ",".join(cases.spans(text[r.doc_id], cases.PERSONAL))
        assert r.base == want and r.sha == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
    assert not pii.find_personal_data(nothing).collect()


def test_boosting_learns(spark):
    """Trees tell formats apart by the features that differ."""
    rows = [("4111 1111 1111 1111", " card ", " x", 1), ("4111 1111 1111 1112 99", " order ", " y", 0)] * 40
    c = pii.features(spark.createDataFrame(rows, "m string, before string, after string, label int"))
    start, trees = pii.boost(c.withColumn("weight", F.lit(1.0)))
    score = sum((pii.tree_value(t) for t in trees), F.lit(start))
    got = {r.label: r.s for r in c.select("label", score.alias("s")).distinct().collect()}
    assert got[1] > 1 > -1 > got[0]


def test_boosting_learns_from_all_candidates(spark):
    """The trees start from the share of positive ones among all candidates that aren't held out."""
    c = spark.range(25_000).select(F.concat(F.lit("+49 30 "), F.col("id").cast("string")).alias("m"), F.lit(" x ").alias("before"), F.lit(".").alias("after"), (F.col("id") % 9 == 0).cast("int").alias("label"))
    own = c.where(F.pmod(F.xxhash64("m", "before", "after"), F.lit(4)) != 0).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    start, _, _ = pii.fit(pii.features(c).withColumn("exact", F.lit(False)))
    assert start == math.log(own.pos / (own.n - own.pos))


def test_personal_data_in_other_forms(spark):
    """Planted spelled-out addresses and numbers are found at recall 0.9 or more, other numbers left alone."""
    plain = [(i, f"Write to anna.{i}@post{i % 7}.example.org or call +1 ({200 + i % 700}) 555-{1000 + i}. Order {10**11 + i * 7919} of 2024-01-{1 + i % 28:02d} 10:30") for i in range(300)]
    hidden = [(1000 + 3 * i, f"reach bob{i} [at] mail{i % 5} [dot] example [dot] com today") for i in range(40)]
    hidden += [(1001 + 3 * i, f"anna{i} (at) mail.example.com is the way") for i in range(40)]
    hidden += [(1002 + 3 * i, f"my tel: 0049 30 {1234567 + i} works") for i in range(40)]
    clean = [(5000 + i, f"Build {i}.4.2 took {123456 + i} ms, version 1.2.3.4.{i}, id {98765432100 + i}, on 2023-11-{1 + i % 28:02d} 11") for i in range(60)]
    found = {r.doc_id: r.other for r in pii.find_personal_data(spark.createDataFrame(plain + hidden + clean, "doc_id long, text string").repartition(3)).select("doc_id", "other").collect()}
    assert sum(bool(found[i]) for i, _ in hidden) >= 0.9 * len(hidden)
    assert sum(bool(found[i]) for i, _ in plain + clean) <= 0.02 * len(plain + clean)


def test_personal_data_of_a_long_text(spark):
    """Twenty thousand matches in a text: as brute force, in time linear in them."""
    long = " ".join(f"{i % 256}.{i % 199}.7.{i % 97} u{i}@h.example" for i in range(10000))
    r = pii.find_personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).select(pii.listed(F.col("base")).alias("base")).first()
    assert r.base == ",".join(cases.spans(long, cases.PERSONAL))
