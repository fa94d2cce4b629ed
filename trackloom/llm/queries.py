"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from trackloom.llm.contamination import OP2_SQL, op2_benchmark_containment
from trackloom.llm.html import op10_html_blocks
from trackloom.llm.huffman import op8_huffman_ids
from trackloom.llm.language import op3_language_viterbi
from trackloom.llm.media import op5_mpeg_audio
from trackloom.llm.packing import op4_best_fit_packing
from trackloom.llm.quality import op6_quality_trees
from trackloom.llm.simhash import op1_simhash_vptree
from trackloom.llm.suffix import op9_suffix_dedup
from trackloom.llm.unigram import op7_unigram_counts

QUERIES = {
    "op1_simhash_vptree": op1_simhash_vptree,
    "op2_benchmark_containment": op2_benchmark_containment,
    "op3_language_viterbi": op3_language_viterbi,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_quality_trees": op6_quality_trees,
    "op7_unigram_counts": op7_unigram_counts,
    "op8_huffman_ids": op8_huffman_ids,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_html_blocks": op10_html_blocks,
}
ORACLE_SQL: dict[str, str] = {"op2_benchmark_containment": OP2_SQL}
