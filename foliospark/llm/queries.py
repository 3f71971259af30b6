"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import exact_dedup, hilbert, jaccard_join, lexical_search, line_dedup, lm_score, media, mixing, packing, phrases, pii, setsketch, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_pii": pii.op4_pii,
    "op5_hilbert_shards": hilbert.op5_hilbert_shards,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_packing": packing.op8_packing,
    "op9_media": media.op9_media,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_phrases": phrases.op11_phrases,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_near_duplicates": setsketch.op13_near_duplicates,
}

ORACLES = {"op10_exact_dedup": exact_dedup.OP10_SQL, "op11_phrases": phrases.OP11_SQL, "op12_lexical_search": lexical_search.OP12_SQL}
