"""Registered queries of this folder and the SQL they are checked against."""

from streamwarden.llm import bpe, exact_dedup, jaccard, lattice_lm, licences, packing, periodic, pii, pivot_search, quality, substrings, token_counts, whitening
from streamwarden.session import prepare

_QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pivot_top_k": pivot_search.op3_pivot_top_k,
    "op4_pii_semi_crf": pii.op4_pii_semi_crf,
    "op5_length_histogram": token_counts.op5_length_histogram,
    "op6_best_two_fit": packing.op6_best_two_fit,
    "op7_licence_digests": licences.op7_licence_digests,
    "op8_bpe_encoding_decoding": bpe.op8_bpe_encoding_decoding,
    "op9_subword_lattice": lattice_lm.op9_subword_lattice,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_substring_dedup": substrings.op12_substring_dedup,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}


def _prepared(query):
    def run(spark, folder):
        return query(prepare(spark), folder)

    return run


QUERIES = {name: _prepared(query) for name, query in _QUERIES.items()}
ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_pivot_top_k": pivot_search.ORACLE,
    "op7_licence_digests": licences.ORACLE,
    "op12_substring_dedup": substrings.ORACLE,
}
