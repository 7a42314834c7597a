"""The numbered queries, by name."""

from curio.llm import decontam, hard_negatives, jaccard, kn_lm, mixing, nn_descent, pii, quality, suffix_dedup, templates, token_shards, toxicity, whitening

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii,
        suffix_dedup.op2_suffix_dedup,
        nn_descent.op3_nn_descent,
        mixing.op4_mixing,
        jaccard.op5_jaccard,
        token_shards.op6_token_shards,
        quality.op7_quality,
        kn_lm.op8_kneser_ney,
        toxicity.op9_toxicity,
        decontam.op10_decontamination,
        whitening.op11_whitening,
        templates.op12_html_extraction,
        hard_negatives.op13_hard_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {"op10_decontamination": decontam.OP10_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
