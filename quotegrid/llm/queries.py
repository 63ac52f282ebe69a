"""The dealt operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from quotegrid.llm import (bpe_tree, clause_grammar, cover_dedup, language_spans, multi_index, prefix_join, quality_rules, resync_counts, sentence_spans,
                           spelling_blocks, squares_packing, target_resampling, warc_dictionary)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_query,
    "op2_warc_dictionary": warc_dictionary.op2_query,
    "op3_language_spans": language_spans.op3_query,
    "op4_bpe_tree": bpe_tree.op4_query,
    "op5_sentence_spans": sentence_spans.op5_query,
    "op6_multi_index": multi_index.op6_query,
    "op7_prefix_join": prefix_join.op7_query,
    "op8_resync_counts": resync_counts.op8_query,
    "op9_cover_dedup": cover_dedup.op9_query,
    "op10_squares_packing": squares_packing.op10_query,
    "op11_spelling_blocks": spelling_blocks.op11_query,
    "op12_clause_grammar": clause_grammar.op12_query,
    "op13_target_resampling": target_resampling.op13_query,
}
ORACLES = {"op2_warc_dictionary": warc_dictionary.OP2_SQL}
