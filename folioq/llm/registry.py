"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation_repair, decontaminate, html_extract, license_scan, lm_scoring, mixing, parity_join, quality_rules, ranked_search, sharding, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_near_duplicates": simhash.op3_near_duplicates,
    "op4_main_text": html_extract.op4_main_text,
    "op5_benchmark_hits": decontaminate.op5_benchmark_hits,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op7_lm_scores": lm_scoring.op7_lm_scores,
    "op8_repeated_passages": substring_dedup.op8_repeated_passages,
    "op9_licence_scan": license_scan.op9_licence_scan,
    "op10_quality_verdicts": quality_rules.op10_quality_verdicts,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_ngram_jaccard_join": parity_join.op12_ngram_jaccard_join,
    "op13_ranked_search": ranked_search.op13_ranked_search,
    "shards_of_64_kib": sharding.shards_of_64_kib,
    "quality_at_loose_risk": quality_rules.quality_at_loose_risk,
}
ORACLES = {
    "op2_source_mix": mixing.SQL,
    "op5_benchmark_hits": decontaminate.SQL,
    "op6_byte_shards": sharding.SQL,
    "op8_repeated_passages": substring_dedup.SQL,
    "op9_licence_scan": license_scan.SQL,
    "op10_quality_verdicts": quality_rules.SQL,
    "op12_ngram_jaccard_join": parity_join.SQL,
    "op13_ranked_search": ranked_search.SQL,
    "shards_of_64_kib": sharding.SQL_SMALL,
    "quality_at_loose_risk": quality_rules.SQL_LOOSE,
}
