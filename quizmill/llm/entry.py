"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from quizmill.llm import chat_format, conversation_repair, decontaminate, exact_dedup, hard_negatives, jaccard_join, language_id, line_dedup, minhash_join, packing, pii, quality, token_output

MODULES = {
    "op1_token_output": token_output,
    "op2_decontaminate": decontaminate,
    "op3_jaccard_join": jaccard_join,
    "op4_packing": packing,
    "op5_pii": pii,
    "op6_line_dedup": line_dedup,
    "op7_chat_format": chat_format,
    "op8_quality": quality,
    "op9_language_id": language_id,
    "op10_exact_dedup": exact_dedup,
    "op11_minhash_join": minhash_join,
    "op12_conversation_repair": conversation_repair,
    "op13_hard_negatives": hard_negatives,
}

QUERIES = {name: m.query for name, m in MODULES.items()}
ORACLE_SQL = {name: m.ORACLE_SQL for name, m in MODULES.items() if m.ORACLE_SQL}
