"""Joins, limits, solvers and statistics over records and candidate pairs."""

from veilmatch.operators.candidates import (
    block_similarity,
    dice_coefficient,
    dice_coefficient_pairs,
    encode_records,
    enforce_k,
    find_candidate_pairs,
    find_limited_pairs,
    hamming_similarity,
    merge_pairs,
    popcount_arrays,
    simple_matching_coefficient,
)
from veilmatch.operators.chunks import chunks_table, process_chunk, split_to_chunks
from veilmatch.operators.deciding import deciding_pairs, score_counts
from veilmatch.operators.ledger import finished_tiles, run_chunks
from veilmatch.operators.merging import merge_rounds
from veilmatch.operators.similarity import DICE, SMC, Similarity, custom_similarity
from veilmatch.operators.solving import greedy_solve, match_labels, matching_rounds, nested_groups, pairs_from_groups, pivot_matching, probabilistic_greedy_solve, undecided_pairs
from veilmatch.operators.stats import cumul_number_matches_vs_threshold, match_hist_of_records, match_ratio, matches_nonmatches_hist, nonmatch_index_of_records, nonmatch_index_score, nonmatch_index_scores, precision_recall, precision_recall_of_classes, similarities_hist

__all__ = [
    "DICE",
    "SMC",
    "Similarity",
    "block_similarity",
    "chunks_table",
    "cumul_number_matches_vs_threshold",
    "custom_similarity",
    "deciding_pairs",
    "dice_coefficient",
    "dice_coefficient_pairs",
    "encode_records",
    "enforce_k",
    "find_candidate_pairs",
    "find_limited_pairs",
    "finished_tiles",
    "greedy_solve",
    "hamming_similarity",
    "match_hist_of_records",
    "match_labels",
    "match_ratio",
    "matches_nonmatches_hist",
    "matching_rounds",
    "merge_pairs",
    "merge_rounds",
    "nested_groups",
    "nonmatch_index_of_records",
    "nonmatch_index_score",
    "nonmatch_index_scores",
    "pairs_from_groups",
    "pivot_matching",
    "popcount_arrays",
    "precision_recall",
    "precision_recall_of_classes",
    "probabilistic_greedy_solve",
    "process_chunk",
    "run_chunks",
    "score_counts",
    "similarities_hist",
    "simple_matching_coefficient",
    "split_to_chunks",
    "undecided_pairs",
]
