"""The corpus queries by name, and their DuckDB oracles."""

from __future__ import annotations

from scriptloom.llm import bpe, clusters, conversations, decontam, exact, language, near, quality, secrets, substrings, topk, toxicity, urls

_QUERIES = {
    "op2_near": near.op2_near,
    "op3_substrings": substrings.op3_substrings,
    "op8_decontamination": decontam.op8_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op4_language": language.op4_language,
    "op1_secrets": secrets.op1_secrets,
    "op9_urls": urls.op9_urls,
    "op5_exact": exact.op5_exact,
    "op6_bpe": bpe.op6_bpe,
    "op10_quality": quality.op10_quality,
    "op11_top_products": topk.op11_top_products,
    "op12_conversations": conversations.op12_conversations,
    "op13_clusters": clusters.op13_clusters,
}
_ORACLES: dict[str, str] = {
    "op2_near": near.ORACLE,
    "op3_substrings": substrings.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op1_secrets": secrets.ORACLE,
    "op9_urls": urls.ORACLE,
    "op11_top_products": topk.ORACLE,
    "op12_conversations": conversations.ORACLE,
    "op13_clusters": clusters.ORACLE,
    "op5_exact": exact.ORACLE,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
