"""Linking a stream of new records against known ones (an addition; batch results are the contract)."""

from veilmatch.streaming.linkage import block_index, link_stream

__all__ = ["block_index", "link_stream"]
