"""Registered queries of the corpus operators, and SQL where SQL can express one."""

from __future__ import annotations

from creditloom.llm import (
    bpe, conversation_repair, exact_dedup, html_text, line_dedup, mixing, ngram_join, quality_rules, resampling, secrets, url_filter, warc,
    whitening,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_extraction": html_text.op4_html_extraction,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_resampling": resampling.op10_resampling,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_secret_scan": secrets.op13_secret_scan,
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op5_ngram_jaccard": ngram_join.SQL,
    "op6_mixing": mixing.SQL,
    "op7_warc": warc.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
}
