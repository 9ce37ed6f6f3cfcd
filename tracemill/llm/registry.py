"""The queries of this package and their SQL."""

from __future__ import annotations

from tracemill.llm import alignment, conversations, decontaminate, katz, licenses, mixing, nearest, packing, passages, quality, simhash, tokens, topk

QUERIES = {
    "op1_nearest": nearest.op1_nearest,
    "op2_simhash": simhash.op2_simhash,
    "op3_katz": katz.op3_katz,
    "op4_section_tokens": tokens.op4_section_tokens,
    "op5_licenses": licenses.op5_licenses,
    "op6_passages": passages.op6_passages,
    "op7_mix": mixing.op7_mix,
    "op8_pack": packing.op8_pack,
    "op9_quality": quality.op9_quality,
    "op10_topk": topk.op10_topk,
    "op11_conversations": conversations.op11_conversations,
    "op12_alignment": alignment.op12_alignment,
    "op13_decontaminate": decontaminate.op13_decontaminate,
}
SQL = {"op5_licenses": licenses.OP5_SQL, "op10_topk": topk.OP10_SQL, "op13_decontaminate": decontaminate.OP13_SQL}
