"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from lattica.llm import decontaminate, html_text, jaccard, langid, licenses, lm, mixing, quality, surrogates, url_rules

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_html_text": html_text.op2_html_text,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_language": langid.op7_language,
    "op8_lm": lm.op8_lm,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_rules": quality.op10_quality_rules,
}

SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op5_url_rules": url_rules.OP5_SQL,
}
