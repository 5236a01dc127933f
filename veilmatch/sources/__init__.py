"""Where records and candidate pairs come from and go to."""

from veilmatch.sources.clks import random_clks, random_problem, read_clk_json, read_truth_json, write_clk_json
from veilmatch.sources.pairs import (
    PairFiles,
    dump_candidate_pairs,
    dump_candidate_pairs_iter,
    dump_size,
    load_candidate_pairs,
    load_to_iterable,
    merge_streams,
    merge_streams_iter,
    register,
)

__all__ = [
    "PairFiles",
    "dump_candidate_pairs",
    "dump_candidate_pairs_iter",
    "dump_size",
    "load_candidate_pairs",
    "load_to_iterable",
    "merge_streams",
    "merge_streams_iter",
    "random_clks",
    "random_problem",
    "read_clk_json",
    "read_truth_json",
    "register",
    "write_clk_json",
]
