"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from snaptide.llm import (
    bpe, chat, exact_dedup, licenses, near_dedup, packing, quality, repair, sentence_pieces, site_quality, substrings, urls,
    vector_codes,
)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_repeated_substrings": substrings.query,
    "op3_license_scan": licenses.query,
    "op4_quality_rules": quality.query,
    "op5_minhash_near_dedup": near_dedup.query,
    "op6_bpe_round_trip": bpe.query,
    "op7_site_quality": site_quality.query,
    "op8_chat_format": chat.query,
    "op9_url_filter": urls.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_sentence_pieces": sentence_pieces.query,
    "op13_conversation_repair": repair.query,
}
ORACLES = {"op8_chat_format": chat.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE,
           "op11_vector_codes": vector_codes.ORACLE}
