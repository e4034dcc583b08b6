"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from kgspark.llm import ctw, decontam, fim, lexical, merkle, neardup, packing, pii, setjoin, sharding, substring, toxicity, urls

QUERIES = {
    "op4_sampled_splitters": sharding.op4_sampled_splitters,
    "op10_url_ratio": urls.op10_url_ratio,
    "op1_pii": pii.op1_pii,
    "op2_merkle": merkle.op2_merkle,
    "op9_toxicity": toxicity.op9_toxicity,
    "op6_context_tree": ctw.op6_context_tree,
    "op8_anchor_dedup": substring.op8_anchor_dedup,
    "op3_pack": packing.op3_pack,
    "op5_minmax_neardup": neardup.op5_minmax_neardup,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op11_bucket_search": lexical.op11_bucket_search,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_jaccard_join": setjoin.op13_jaccard_join,
}
ORACLES = {
    "op10_url_ratio": urls.ORACLE,
    "op2_merkle": merkle.ORACLE,
    "op8_anchor_dedup": substring.ORACLE,
    "op5_minmax_neardup": neardup.ORACLE,
    "op7_decontaminate": decontam.ORACLE,
    "op11_bucket_search": lexical.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_jaccard_join": setjoin.ORACLE,
}
