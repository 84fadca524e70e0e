"""Queries of the training-data operators, by name."""

from __future__ import annotations

from loomgraph.llm import decontamination, fill_middle, filter_audit, line_dedup, mixing, ngram_join, pii, quality_model, quality_rules, secrets, sharding, suffix_dedup, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_secrets": secrets.op3_secrets,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_shards": sharding.op7_shards,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_personal_data": pii.op10_personal_data,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_warc": warc.op13_warc,
}
#: Newton steps, fingerprints, networks and propagation are not for SQL; tests hold those queries against brute force.
SQL: dict[str, str] = {"op11_filter_audit": filter_audit.SQL, "op12_fill_middle": fill_middle.SQL, "op13_warc": warc.SQL}
