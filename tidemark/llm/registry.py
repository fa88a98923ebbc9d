"""Queries of the operators and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import bpe, chat, embedding_dedup, exact_dedup, language_id, lm, mixing, pii, quality, simhash

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_bpe": bpe.op3_bpe,
    "op4_embedding_near_dedup": embedding_dedup.op4_embedding_near_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_pii": pii.op6_pii,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_language_id": language_id.op8_language_id,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op4_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
    "op7_chat_formatting": chat.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
