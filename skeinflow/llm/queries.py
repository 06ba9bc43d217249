"""The operators' queries over whole tables, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from skeinflow.llm import decontaminate, filter_audit, merkle, mixing, near_vectors, ngram_join, pii, quality_classifier, quality_rules, sharding, substring_dedup, url_filters, warc

QUERIES = {
    "op1_url_filter": url_filters.op1_url_filter,
    "url_aliases": url_filters.url_aliases,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_extendible_hash_shards": sharding.op5_extendible_hash_shards,
    "shards_of_128_kb": sharding.shards_of_128_kb,
    "op6_personal_data": pii.op6_personal_data,
    "planted_identifiers": pii.planted_identifiers,
    "op7_host_quality": quality_rules.op7_host_quality,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_embedding_links": near_vectors.op12_embedding_links,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op1_url_filter": url_filters.ORACLE,
    "url_aliases": url_filters.ALIASES,
    "op3_warc_round_trip": warc.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_extendible_hash_shards": sharding.oracle(),
    "shards_of_128_kb": sharding.oracle(128 << 10),
    "planted_identifiers": pii.PLANTED,
    "op7_host_quality": quality_rules.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_ngram_jaccard": ngram_join.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_embedding_links": near_vectors.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
