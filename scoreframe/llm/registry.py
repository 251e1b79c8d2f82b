"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from scoreframe.llm import chat, decontaminate, media, merkle, mixing, near_dedup, packing, quality_model, quality_rules, token_counts, toxicity, url_filter, whitening

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_chat_format": chat.op4_chat_format,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_media": media.op10_media,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op8_quality_rules": quality_rules.oracle(), "op9_near_dedup": near_dedup.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE, "op12_merkle_manifest": merkle.ORACLE,
}
