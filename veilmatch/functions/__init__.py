"""Column functions: bit strings, similarity coefficients, blocking keys."""

from veilmatch.functions.bits import all_equal, clk_words, dice, get_bit, logand_count, popcount, py_floordiv, smc
from veilmatch.functions.blocking import Blocking, bit_blocking, block_and, block_or, continuous_blocking, custom_blocking, list_blocking

__all__ = ["Blocking", "all_equal", "bit_blocking", "block_and", "block_or", "clk_words", "continuous_blocking", "custom_blocking", "dice", "get_bit", "list_blocking", "logand_count", "popcount", "py_floordiv", "smc"]
