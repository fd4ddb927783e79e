"""Queries of the training-data operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from roadloom.llm import chat, exact_dedup, fim, langid, media, mixing, neardup, pieces, runs, secrets, token_counts, toxicity, wrappers

QUERIES = {
    "op1_chat": chat.query,
    "op2_toxicity": toxicity.query,
    "op3_media": media.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_token_counts": token_counts.query,
    "op6_minhash": neardup.query,
    "op7_secrets": secrets.query,
    "op8_pieces": pieces.query,
    "op9_mixing": mixing.query,
    "op10_langid": langid.query,
    "op11_wrappers": wrappers.query,
    "op12_fim": fim.query,
    "op13_runs": runs.query,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op12_fim": fim.ORACLE,
}
