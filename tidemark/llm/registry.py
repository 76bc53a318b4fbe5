"""The registered queries of this subpackage, one for each operator, and their SQL."""
from __future__ import annotations

from tidemark.llm import (alignment, bpe, conversations, decontaminate, html_wrapper, mixing, near_dedup, pii_feistel, quality, secret_ledger,
                          substring_dedup, suffix_dedup, url_filter)

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_suffix_array_dedup": suffix_dedup.query,
    "op4_secret_ledger": secret_ledger.query,
    "op5_pii_pseudonyms": pii_feistel.query,
    "op6_url_filter": url_filter.query,
    "op7_html_extraction": html_wrapper.query,
    "op8_quality_rules": quality.query,
    "op9_source_mixing": mixing.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_conversation_repair": conversations.query,
    "op12_bpe": bpe.query,
    "op13_tokenizer_alignment": alignment.query,
}

ORACLE_SQL = {
    "op1_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op3_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op4_secret_ledger": secret_ledger.ORACLE_SQL,
    "op9_source_mixing": mixing.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
}
