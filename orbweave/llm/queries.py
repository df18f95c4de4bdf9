"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    decontamination,
    exact_search,
    license_scans,
    packing,
    personal_data,
    prefix_trie,
    quality_classifier,
    quality_rules,
    ranked_search,
    sharding,
    simhash_dedup,
    token_counts,
    url_filters,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_license_scans": license_scans.op3_license_scans,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_personal_data": personal_data.op7_personal_data,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_exact_search": exact_search.op12_exact_search,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = url_filters.ORACLE | license_scans.ORACLE | quality_rules.ORACLE | ranked_search.ORACLE | exact_search.ORACLE | prefix_trie.ORACLE
