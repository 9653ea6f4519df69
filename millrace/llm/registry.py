"""The queries of this subpackage and their SQL."""

from millrace.llm import bpe, exact_dedup, jaccard, langid, lexical, lm, negatives, packing, pii, quality, suffix, topk, warc

QUERIES = {
    "op1_run_length_index": suffix.op1,
    "op2_merkle_fixity": warc.op2,
    "op3_segment_tree_bpe": bpe.op3,
    "op4_subword_quality": quality.op4,
    "op5_pivot_distance_topk": topk.op5,
    "op6_tree_merge_dedup": exact_dedup.op6,
    "op7_causal_attention_lm": lm.op7,
    "op8_bootstrapped_pii": pii.op8,
    "op9_multi_order_jaccard": jaccard.op9,
    "op10_window_packing": packing.op10,
    "op11_bitmask_language": langid.op11,
    "op12_norm_bucket_negatives": negatives.op12,
    "op13_tiered_search": lexical.op13,
}

ORACLES = {
    "op2_merkle_fixity": warc.ORACLE,
    "op5_pivot_distance_topk": topk.ORACLE,
    "op6_tree_merge_dedup": exact_dedup.ORACLE,
    "op12_norm_bucket_negatives": negatives.ORACLE,
    "op13_tiered_search": lexical.ORACLE,
}
