"""The queries of the ten operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, lattice, mixing, neighbours, packing, recompress, suffixes, toxicity


def queries() -> dict:
    return {
        "op1_projected_neighbours": neighbours.op1_projected_neighbours,
        "op2_lattice_lm": lattice.op2_lattice_lm,
        "op3_chat_format": chat.op3_chat_format,
        "op4_recompression": recompress.op4_recompression,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pack_tokens": packing.op7_pack_tokens,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": mixing.OP8_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
