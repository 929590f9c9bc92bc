"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_network, html_text, jaccard, mixing, phrases, pipeline, quality_rules, sentencepieces, sharding, spelling, substrings, token_counts, topk, winnowing


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_mixing_sources": mixing.op3_mixing_sources,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality_classifier": byte_network.op5_quality_classifier,
        "op6_substring_dedup": substrings.op6_substring_dedup,
        "op7_exact_topk": topk.op7_exact_topk,
        "op8_sentencepiece": sentencepieces.op8_sentencepiece,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_html_extraction": html_text.op10_html_extraction,
        "op11_phrase_collocations": phrases.op11_phrase_collocations,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_fingerprints": winnowing.op13_fingerprints,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing_sources": mixing.OP3_SQL, "op7_exact_topk": topk.OP7_SQL, "op11_phrase_collocations": phrases.OP11_SQL, "op12_spelling_variants": spelling.OP12_SQL}
