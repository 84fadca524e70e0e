"""The pipeline's stages on small tables: decisions take effect, columns stay, nothing clean is lost."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [(1000 + i, " ".join(cases.prose(500 + i, 80)), "en", f"src{i % 3}", 0) for i in range(40)]
    spark.createDataFrame(cases.documents() + clean, cases.SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in clean], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(clean[3][1].split()[10:50]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert all(ids[1000 + i] == 1 for i in range(40)) and not ids[0] and not ids[20]
    one = stages["ngram_join"](spark, docs, folder)
    ids = Counter(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and max(ids.values()) == 1
    linked = {k for k in cases.ngram_join(cases.documents())}
    assert {i for i in ids if i is not None and i < 1000} == {k[0] for k in linked if k[0] == k[2]} and None in ids
    clear = stages["decontamination"](spark, docs, folder)
    assert clear.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clear.collect()} == {1003}
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.where("doc_id >= 1000").collect()).values()) <= 3


def test_near_duplicates_of_five_words(spark, folder):
    """One document stays of each group at five words and 0.8, as brute force has it."""
    base = [cases.prose(800 + i, 60) for i in range(4)]
    texts = [base[0], [*base[0], *cases.prose(91, 12)], base[1], [*base[1][:30], "edit", *base[1][31:]], base[2], [*base[2], *cases.prose(92, 30)], base[3]]
    grams = [{tuple(cases.words(cases.low(" ".join(x))))[k : k + 5] for k in range(len(x) - 4)} for x in texts]
    want = {j for j in range(len(texts)) if not any(100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]) for i in range(j))}
    docs = spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in enumerate(texts)], cases.SCHEMA)
    assert want == {0, 2, 4, 5, 6}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, folder).collect()} == want


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    n = Counter(r.shard for r in out)
    assert out and max(n.values()) - min(n[k] for k in range(8)) <= 1
    assert 1003 not in {r.doc_id for r in out}


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).collect()
