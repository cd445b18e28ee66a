"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sitelens.llm import hard_negatives, jaccard_join, licences, media, mixing, neighbours, packing, quality, quality_rules, secrets, spelling, substrings, url_filter


def queries() -> dict:
    made = [
        licences.op1_licence_dice, packing.op2_harmonic_packing, quality.op3_line_field_quality, secrets.op4_secret_forest,
        substrings.op5_substring_dedup, jaccard_join.op6_jaccard_join, media.op7_baseline_jpeg, mixing.op8_curriculum_mix,
        url_filter.op9_url_boosting, neighbours.op10_posting_lists, spelling.op11_trie_variants, hard_negatives.op12_hard_negatives, quality_rules.op13_monotone_rules,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    # op5 is SQL too, but its windows of whole tables take DuckDB long; tests compare it by brute force.
    return {"op11_trie_variants": spelling.SQL, "op12_hard_negatives": hard_negatives.SQL}
