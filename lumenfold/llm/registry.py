"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lumenfold.llm import ann, chat_format, decontaminate, jaccard_join, lexical_search, licenses, mixing, pii, prefix_trie, sharding, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_sharding": sharding.op2_sharding,
    "op3_jaccard": jaccard_join.op3_jaccard,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_licenses": licenses.op5_licenses,
    "op6_pii": pii.op6_pii,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_ann": ann.op8_ann,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_mix": mixing.op10_mix,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_chat": chat_format.op12_chat,
    "op13_lexical": lexical_search.op13_lexical,
}

ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op3_jaccard": jaccard_join.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_mix": mixing.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_chat": chat_format.SQL,
    "op13_lexical": lexical_search.SQL,
}
