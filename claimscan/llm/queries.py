"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, language_id, lexical_search, lm_scoring, minhash_dedup, packing, quality_crf, quality_rules, sharding, source_mixing, spelling_variants, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_quality_crf": quality_crf.op4_quality_crf,
    "op5_packing": packing.op5_packing,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_language_id": language_id.op10_language_id,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_source_mixing": source_mixing.op12_source_mixing,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

#: The others use hashing, learned models, a parser or a tokenizer, which DuckDB's SQL lacks; tests/llm compares them with brute force.
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op11_spelling_variants": spelling_variants.OP11_SQL,
    "op12_source_mixing": source_mixing.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
