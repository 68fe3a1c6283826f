"""Queries of the corpus operators, and the SQL that some are checked against."""

from __future__ import annotations

from tablewright.llm import audio, chat, lm, minhash, mixing, nearest, negatives, packing, pii, quality, rules, spelling, toxicity

_QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_mix": mixing.op2_mix,
    "op3_pii": pii.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_lm": lm.op5_lm,
    "op6_chat": chat.op6_chat,
    "op7_audio": audio.op7_audio,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_rules": rules.op9_rules,
    "op10_pack": packing.op10_pack,
    "op11_spelling": spelling.op11_spelling,
    "op12_nearest": nearest.op12_nearest,
    "op13_negatives": negatives.op13_negatives,
}
_ORACLE: dict[str, str] = {
    "op2_mix": mixing.ORACLE,
    "op6_chat": chat.ORACLE,
    "op9_rules": rules.ORACLE,
    "op13_negatives": negatives.ORACLE,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
