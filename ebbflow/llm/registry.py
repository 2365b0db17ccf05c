"""The subpackage's queries and their SQL."""

from __future__ import annotations

from ebbflow.llm import bpe, chat, gif, langid, mixing, sharding, simhash, tokenfiles, topk, toxicity

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_chat_format": chat.op3_chat_format,
    "op4_simhash": simhash.op4_simhash,
    "op5_gif_media": gif.op5_gif_media,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_shards": sharding.op7_shards,
    "op8_token_files": tokenfiles.op8_token_files,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe_roundtrip": bpe.op10_bpe_roundtrip,
}

ORACLES = {
    "op3_chat_format": chat.ORACLE,
    "op6_exact_topk": topk.ORACLE,
}
