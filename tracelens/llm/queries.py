"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from tracelens.llm import chat, decontam, jaccard, langid, media, mixing, suffix_dedup, tokens, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_media_ts": media.op4_media_ts,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_language_id": langid.op7_language_id,
    "op8_warc_derivatives": warc.op8_warc_derivatives,
    "op9_mixing": mixing.op9_mixing,
    "op10_chat_roles": chat.op10_chat_roles,
}

ORACLE = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_decontamination": decontam.SQL,
    "op5_jaccard_join": jaccard.SQL,
    "op9_mixing": mixing.SQL,
}
