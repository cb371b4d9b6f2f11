"""The registered query of each training-data operator, and its SQL where SQL can express it."""

from . import collocations, exact_dedup, jaccard_join, lm_scoring, mixing, packing, quality, substring_dedup, toxicity, url_filter, vector_dedup, warc, whitening

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_lm_score": lm_scoring.op2_lm_score,
    "op3_pack": packing.op3_pack,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_vector_dedup": vector_dedup.op5_vector_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_warc": warc.op7_warc,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_whitening": whitening.op11_whitening,
    "op12_quality": quality.op12_quality,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
