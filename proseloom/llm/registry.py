"""The queries of this package and their SQL."""

from __future__ import annotations

from . import katz, lexical, media, mixing, nearjoin, oracle, packing, pieces, quality, repeats, resampling, sharding, topk

QUERIES = {
    "op1_matroska": media.op1_matroska,
    "op2_katz": katz.op2_katz,
    "op3_voronoi_top_k": topk.op3_voronoi_top_k,
    "op4_factorisation_machine": quality.op4_factorisation_machine,
    "op5_sparse_suffix_array": repeats.op5_sparse_suffix_array,
    "op6_feistel_shards": sharding.op6_feistel_shards,
    "op7_chosen_path": nearjoin.op7_chosen_path,
    "op8_bounded_packing": packing.op8_bounded_packing,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_fm_index": repeats.op10_fm_index,
    "op11_cube_mixing": mixing.op11_cube_mixing,
    "op12_dual_tree_search": lexical.op12_dual_tree_search,
    "op13_bit_sliced_resampling": resampling.op13_bit_sliced_resampling,
}
SQL: dict[str, str] = {"op3_voronoi_top_k": topk.SQL, "op5_sparse_suffix_array": oracle.SPANS, "op7_chosen_path": oracle.NEAR, "op10_fm_index": oracle.SUBSTRING, "op12_dual_tree_search": oracle.SEARCH, "op13_bit_sliced_resampling": oracle.RESAMPLE}
