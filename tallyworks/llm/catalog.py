"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tallyworks.llm import alignment, bpe, exact_dedup, fim, language, mixing, near_dedup, pii, ppm, quality, secrets, topk, toxicity


def queries() -> dict:
    return {
        "op1_topk_search": topk.op1_topk_search,
        "op2_quality": quality.op2_quality,
        "op3_language_id": language.op3_language_id,
        "op4_near_duplicates": near_dedup.op4_near_duplicates,
        "op5_source_mix": mixing.op5_source_mix,
        "op6_ppm_score": ppm.op6_ppm_score,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_pii": pii.op8_pii,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_bpe": bpe.op10_bpe,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_toxicity": toxicity.op12_toxicity,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.ORACLE, "op5_source_mix": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op11_fill_in_middle": fim.ORACLE}
