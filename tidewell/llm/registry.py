"""The operators' queries and SQL."""

from __future__ import annotations

from tidewell.llm import decontaminate, language_id, line_dedup, ngram_lm, packing, periodic, pii, quality, simhash, suffix_dedup, url_filter, vector_codes, vector_links


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_personal_data": pii.op3_personal_data,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_language_model": ngram_lm.op6_language_model,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_packing": packing.op8_packing,
        "op9_language_id": language_id.op9_language_id,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_vector_links": vector_links.op13_vector_links,
    }


def oracle_sql() -> dict:
    return {
        "op2_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op5_line_dedup": line_dedup.ORACLE_SQL,
        "op6_language_model": ngram_lm.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
        "op13_vector_links": vector_links.ORACLE_SQL,
    }
