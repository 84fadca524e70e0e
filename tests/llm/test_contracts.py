"""The opN_ queries on the smallest tables: columns and types of their contracts, one row for each document, SQL where there is some."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from loomgraph.llm import queries

SF = "/root/testdata/sf0.001"
#: Columns that a result must begin with.
COLUMNS = {
    "op1": "doc_id bigint, n_shingles bigint, component_id bigint", "op2": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", "op4": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int", "op7": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want = COLUMNS.get(name.split("_")[0])
    if want:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(want)
    if name in queries.SQL:
        con = duckdb.connect()
        for t in ("documents", "labels", "pages"):
            con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        rel = con.sql(queries.SQL[name])
        assert set(df.columns) == set(rel.columns)
        at = [rel.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    elif want:
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        assert Counter(ids) == Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    else:
        df.limit(1).collect()
