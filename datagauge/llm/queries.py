"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bloom_lm, crosspolytope, hostrep, interactions, langid, minhash, mixing, pieces, quality, token_rollup, toxicity, validtime, wavelet

QUERIES = {
    "op1_token_rollup": token_rollup.op1_token_rollup,
    "op2_bloom_lm": bloom_lm.op2_bloom_lm,
    "op3_wavelet_ids": wavelet.op3_wavelet_ids,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_llr": quality.op5_quality_llr,
    "op6_mixing_flow": mixing.op6_mixing_flow,
    "op7_cross_polytope": crosspolytope.op7_cross_polytope,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_minhash_tensor": minhash.op9_minhash_tensor,
    "op10_language_mixture": langid.op10_language_mixture,
    "op11_filter_interactions": interactions.op11_filter_interactions,
    "op12_valid_time": validtime.op12_valid_time,
    "op13_host_reputation": hostrep.op13_host_reputation,
}
#: SQL of the operators that it expresses; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op11_filter_interactions": interactions.SQL,
    "op12_valid_time": validtime.SQL,
    "op13_host_reputation": hostrep.SQL,
}
