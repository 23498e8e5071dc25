"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import embedding, filter_audit, html_text, language, minhash, mixing, packing, prefix_trie, quality, sharding, suffix_dedup, token_output, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": embedding.op1_multi_index,
    "op2_best_region": html_text.op2_best_region,
    "op3_parquet_tokens": token_output.op3_parquet_tokens,
    "op4_minhash_bayes": minhash.op4_minhash_bayes,
    "op5_sum_of_squares": packing.op5_sum_of_squares,
    "op6_js_quality": quality.op6_js_quality,
    "op7_rank_order": language.op7_rank_order,
    "op8_bounded_ring": sharding.op8_bounded_ring,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_poisson_mix": mixing.op10_poisson_mix,
    "op11_path_counts": filter_audit.op11_path_counts,
    "op12_prefix_forest": prefix_trie.op12_prefix_forest,
    "op13_suffix_merge": suffix_dedup.op13_suffix_merge,
}

ORACLE_SQL: dict[str, str] = {
    "op1_multi_index": embedding.OP1_SQL,
    "op4_minhash_bayes": minhash.OP4_SQL,
    "op6_js_quality": quality.OP6_SQL,
    "op9_warc_revisits": warc.OP9_SQL,
    "op10_poisson_mix": mixing.OP10_SQL,
    "op11_path_counts": filter_audit.OP11_SQL,
    "op12_prefix_forest": prefix_trie.OP12_SQL,
}
