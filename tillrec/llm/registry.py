"""Queries and SQL of the operators."""

from __future__ import annotations

from tillrec.llm import decontaminate, line_spread, minhash, negatives, phrases, pieces, pii, pitman_yor, quality, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_minhash": minhash.op3_minhash,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pitman_yor": pitman_yor.op7_pitman_yor,
    "op8_secrets": secrets.op8_secrets,
    "op9_line_spread": line_spread.op9_line_spread,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_simhash": simhash.op12_simhash,
    "op13_phrases": phrases.op13_phrases,
}

ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_secrets": secrets.OP8_SQL,
    "op9_line_spread": line_spread.OP9_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
