"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from starfold.llm import centroids, chat, classifier, decontaminate, filter_audit, lm, mixing, near_dedup, packing, quality, range_join, suffix, urls

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_chat": chat.op2_chat,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_urls": urls.op6_urls,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_classifier": classifier.op8_classifier,
    "op9_lm": lm.op9_lm,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_centroids": centroids.op12_centroids,
    "op13_range_join": range_join.op13_range_join,
}
ORACLE_SQL = {
    "op2_chat": chat.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_urls": urls.OP6_SQL,
    "op10_quality": quality.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_centroids": centroids.OP12_SQL,
    "op13_range_join": range_join.OP13_SQL,
}
