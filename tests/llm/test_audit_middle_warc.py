"""Filter audit, fill-in-middle and WARC archives against brute force, on the hard cases."""

from __future__ import annotations

import hashlib
import io
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle, filter_audit, warc
from loomgraph.llm.common import written
from tests.llm import cases


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = cases.documents()
    long = " ".join(cases.prose(21, 30_000))
    shouting, copy = "A B C " * 40, rows[6][1]
    rows += [(100, long, "en", "src1", 0), (101, shouting, "en", "src1", 0), (102, shouting, "en", "src2", 0), (101, shouting, "en", "src2", 0), (103, copy, "en", None, 0), (None, copy, "en", "src1", 0), (104, "a <P> b # c", "en", "src3", 0), (105, "x" * 90_000 + " é" * 40_000, "en", "src3", 0)]
    clashing = {c: F.lit("x") for c in ("n", "key", "part", "mask", "deal", "good", "toxic", "step", "pos", "bytes", "form")}
    return rows, spark.createDataFrame(rows, cases.SCHEMA).withColumns(clashing).repartition(4)


LABELS = [(6, 1, 0), (9, 1, 0), (10, 1, 1), (20, 0, 0), (21, 0, 1), (101, 1, None), (101, 0, 1), (99, 1, 0), (None, 1, 1), (None, None, None)]


def audit(rows, labels):
    words = [cases.words(r[1]) for r in rows]
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    fails = []
    for r, w in zip(rows, words, strict=True):
        t = r[1] or ""
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        fails.append({k for k, v in bad.items() if v})
    good, toxic = {x for x, q, _ in labels if q == 1 and x is not None}, {x for x, _, q in labels if q == 1 and x is not None}
    out, shapley = [], Counter()
    for part in {r[3] or "" for r in rows}:
        own = [(f, r[0]) for f, r in zip(fails, rows, strict=True) if (r[3] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(gone)
                out.append((part, order, k + 1, len(left), len(gone), sum(f in x and bool(x & set(order[:k])) for x, _ in own), sum(x == {f} for x, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
    return Counter((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_filter_audit(spark, docs):
    rows, df = docs
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(df, labels)) == audit(rows, LABELS)
    assert rows_of(filter_audit.audit(df, labels.where("false"))) == audit(rows, [])
    assert not filter_audit.audit(df.where("false"), labels).collect()


def test_packed_counters_do_not_overflow():
    """Fields of sums far beyond 32 bits come back as they went in."""
    n = {m: 2**57 + m for m in range(32)}
    fields = filter_audit.unpacked(sum(filter_audit.packed(m) * k for m, k in n.items()))
    assert (fields == sum(filter_audit.unpacked(filter_audit.packed(m)) * k for m, k in n.items())).all()
    assert fields[0] == sum(k for m, k in n.items() if not m & 1)  # kept by the first step of ABCDE
    per_step = fields[: 3 * 600].reshape(3, 600)
    for order in range(120):  # what a step keeps is what the step before it kept, but for what it removes
        kept, removed = per_step[0, 5 * order : 5 * order + 5], per_step[1, 5 * order : 5 * order + 5]
        assert kept[0] + removed[0] == sum(n.values()) and (kept[1:] + removed[1:] == kept[:-1]).all()


def test_words_over_blocks(monkeypatch):
    texts = [" ".join(cases.prose(s, 300)).encode() for s in range(5)] + [b"w" * 500 + b" w w"]
    whole = [filter_audit.failures(x) for x in texts]
    monkeypatch.setattr(filter_audit, "BLOCK", 37)
    assert [filter_audit.failures(x) for x in texts] == whole


def middle(rows):
    out = Counter()
    for r in rows:
        t = r[1] or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t, re.S)
        h = [int(hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()[8 * i :][:8], 16) for i in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sizes = (None, None) if form == "plain" else (len(pre), len(mid))
        out[r[0], len(units), form, *sizes, output, t] += 1
    return out


def test_fill_middle(docs):
    rows, df = docs
    want = middle(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert rows_of(fill_middle.transform(df)) == Counter({x[:6]: n for x, n in want.items()})
    assert rows_of(fill_middle.digests(df)) == Counter({(*x[:5], sha(x[5]), sha(x[6])): n for x, n in want.items()})
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert not fill_middle.digests(df.where("false")).collect() and not fill_middle.transform(df.where("false")).collect()


def test_markers_are_found_wherever_chunks_end():
    r = random.Random(3)
    for form, order in fill_middle.FORMS.items():
        for _ in range(300):
            parts = ["".join(r.choice(["<", ">", "P", "S", "M", "a"]) for _ in range(r.randint(0, 9))) for _ in range(3)]
            if any(re.search("<[PSM]>", p) for p in parts):
                continue
            output = b"".join(fill_middle.MARKERS[p] + parts[p].encode() for p in order)
            ends = sorted(r.sample(range(len(output) + 1), 4))
            got = defaultdict(bytes)
            for part, piece in fill_middle.parsed((output[a:b] for a, b in zip([0, *ends], [*ends, len(output)], strict=True)), form):
                got[part] += piece
            assert [got[p].decode() for p in range(3)] == parts, (form, parts)


def test_tokens_over_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 5)
    monkeypatch.setattr(fill_middle, "PIECE", 7)
    for text in ("abc d éé " * 20, "a" * 40 + "é" + "b" * 9, "ñ" * 30, "x"):
        data = np.frombuffer(text.encode(), np.uint8)
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        counts = fill_middle._tokens(data)
        assert sum(counts) == len(units)
        for k in range(len(units) + 1):
            assert fill_middle._offset(data, counts, k) == len("".join(units[:k]).encode())
        chunks = list(fill_middle._chunks(data, 0, len(data)))
        assert b"".join(chunks).decode() == text and max(map(len, chunks)) <= 7
        assert all(c.decode() for c in chunks)


# --- archives ----------------------------------------------------------------------------------------

BODY = "<p>" + " ".join(cases.prose(7, 60)) + "</p>"
PAGES = [
    (5, "http://a.example/x?b#c", BODY, 10), (3, "http://WWW.a.example:80/x?b", BODY, 5), (9, None, BODY, None), (9, None, BODY, None), (3, "http://b.example/", BODY, 7), (None, "x y\r\nz", BODY, 1),
    (10, "http://b.example/", None, 7), (11, "http://b.example/", "", 8), (12, "http://b.example", "short", 9), (13, "http://b.example", "short", 9),
    (14, "https://c.example/é", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, -5), (15, "https://c.example/é", "é" * 49 + "x", 2**33), (16, "q", "é" * 50, 3), (17, "q", "é" * 50, 3),
    (None, None, "only without ids " * 20, 1), (None, None, "only without ids " * 20, 1), (18, "http://long.example", "".join(cases.prose(8, 200_000)), 4),
]


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, captured long").withColumns({c: F.lit("x") for c in ("n", "first", "value", "run", "deal")})
    warc.write(df.repartition(5), path)
    return path


def test_warc_round_trip(spark, archives):
    payload = lambda p: (p[2] or "").encode()
    first = {}
    for p in PAGES:
        if p[0] is not None:
            first[payload(p)] = min(p[0], first.get(payload(p), p[0]))
    want = Counter()
    for p in PAGES:
        b = payload(p)
        revisit = len(b) >= 100 and b in first and p[0] != first[b]
        want[p[0], len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None] += 1
    got = warc.read(spark, archives)
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_histories_are_in_one_order(spark, archives):
    runs = written(warc.runs(spark, archives), "captures")
    assert len(warc.cuts(runs, 3)) == 5
    got = [r.asDict() for r in warc.histories(runs, 3).orderBy("range", "nth").collect()]
    assert [warc.place(r) for r in got] == sorted(warc.place(r.asDict()) for r in runs.collect())
    assert len({r["range"] for r in got}) > 2
    pages = [r for r in got if r["url_key"] == "example,a)/x?b"]
    assert [r["captured"] for r in pages] == ["1970-01-01T00:00:05Z", "1970-01-01T00:00:10Z"]
    assert {r["captured"] for r in got if r["page_id"] in (14, 15)} == {"1969-12-31T23:59:55Z", "2242-03-16T12:56:32Z"}


def test_warc_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string, captured long")
    warc.write(none, f"file://{tmp_path}/none")
    assert not warc.read(spark, f"file://{tmp_path}/none").collect()


def test_broken_archives_are_errors():
    def record(body: bytes, digest: str) -> bytes:
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n".encode() + body + b"\r\n\r\n"

    good = record(b"abc", hashlib.sha256(b"abc").hexdigest())
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [c["offset"] for c in warc.captures("a", io.BytesIO(info + good + good))] == [len(info), len(info) + len(good)]
    for bad in (record(b"abc", "0" * 64), good[:-8], b"x" + good):
        with pytest.raises(ValueError):
            list(warc.captures("a", io.BytesIO(bad)))


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 30):
        made = [sorted(({"url_key": str(r.randint(0, 9)), "captured": "", "page_id": None, "archive": str(i), "offset": j} for j in range(r.randint(0, 20))), key=warc.place) for i in range(k)]
        assert list(warc.LoserTree(map(iter, made))) == sorted((c for m in made for c in m), key=warc.place)

