"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontam, exact, html, jaccard, licences, mixing, packing, quality, toxicity


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard.op1_jaccard_join,
        "op2_mixing": mixing.op2_mixing,
        "op3_token_packing": packing.op3_token_packing,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_html_extraction": html.op5_html_extraction,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_licence_scan": licences.op9_licence_scan,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op4_chat_formatting": chat.OP4_SQL,
        "op6_exact_dedup": exact.OP6_SQL,
    }
