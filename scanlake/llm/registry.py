"""The registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from scanlake.llm import bloom_search, byte_bpe, divergence, edit_counts, jump_shards, mixing, packing, pairwise_quality, phrases, probminhash, token_alignment, toxicity_chain, winnowing

QUERIES = {
    "op1_bradley_terry": (pairwise_quality.op1_bradley_terry, None),
    "op2_distribution_divergence": (divergence.op2_distribution_divergence, divergence.OP2_SQL),
    "op3_probminhash": (probminhash.op3_probminhash, None),
    "op4_jump_shards": (jump_shards.op4_jump_shards, None),
    "op5_classifier_chain": (toxicity_chain.op5_classifier_chain, None),
    "op6_water_filling": (mixing.op6_water_filling, mixing.OP6_SQL),
    "op7_phrase_automata": (phrases.op7_phrase_automata, phrases.OP7_SQL),
    "op8_exact_complement": (packing.op8_exact_complement, None),
    "op9_winnowing": (winnowing.op9_winnowing, None),
    "op10_edit_aware_counts": (edit_counts.op10_edit_aware_counts, None),
    "op11_bloom_signatures": (bloom_search.op11_bloom_signatures, bloom_search.OP11_SQL),
    "op12_overlapping_chunks": (byte_bpe.op12_overlapping_chunks, None),
    "op13_incidence_products": (token_alignment.op13_incidence_products, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
