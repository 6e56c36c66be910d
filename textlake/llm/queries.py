"""Registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from textlake.llm.centroids import OP13_SQL, op13_centroid_clustering
from textlake.llm.fim import OP11_SQL, op11_fill_in_middle
from textlake.llm.langid import op2_language_bitmask
from textlake.llm.mixing import op1_mix_sources
from textlake.llm.packing import op3_best_fit_packing
from textlake.llm.minhash import op10_minhash_near_dedup
from textlake.llm.pivots import OP8_SQL, op8_pivot_permutation
from textlake.llm.quality import OP4_SQL, op4_quality_divergence
from textlake.llm.rules import op12_rule_ensemble
from textlake.llm.substring import op7_substring_dedup
from textlake.llm.tokens import op5_token_files
from textlake.llm.toxicity import op6_toxicity_cnn
from textlake.llm.warc import OP9_SQL, op9_warc_archives

QUERIES = {
    "op2_language_bitmask": op2_language_bitmask,
    "op6_toxicity_cnn": op6_toxicity_cnn,
    "op8_pivot_permutation": op8_pivot_permutation,
    "op9_warc_archives": op9_warc_archives,
    "op5_token_files": op5_token_files,
    "op7_substring_dedup": op7_substring_dedup,
    "op1_mix_sources": op1_mix_sources,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_divergence": op4_quality_divergence,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op4_quality_divergence": OP4_SQL,
    "op8_pivot_permutation": OP8_SQL,
    "op9_warc_archives": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
