"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from panelyard.llm import ann, bpe, chat, decontaminate, langid, lengths, lm, simhash, toxicity, warc


def queries() -> dict:
    found = [chat.op1_chat_format, bpe.op2_bpe, simhash.op3_simhash, lm.op4_lm_score, decontaminate.op5_decontamination, lengths.op6_token_counts, ann.op7_ann, toxicity.op8_toxicity, warc.op9_warc, langid.op10_language_id]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op5_decontamination": decontaminate.OP5_SQL, "op9_warc": warc.OP9_SQL}
