"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, hard_negatives, jaccard_join, language_id, mixing, prefix_trie, recurrent_lm, sharding, spotsigs, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_spotsigs": spotsigs.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_language_id": language_id.query,
    "op5_token_count": token_count.query,
    "op6_mixing": mixing.query,
    "op7_chat_format": chat_format.query,
    "op8_recurrent_lm": recurrent_lm.query,
    "op9_decontaminate": decontaminate.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_rendezvous_shards": sharding.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_rendezvous_shards": sharding.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
