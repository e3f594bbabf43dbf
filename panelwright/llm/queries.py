"""The registered queries of the corpus operators."""

from panelwright.llm import ann, chat, neardup, packing, passages, pii, prefix_trie, quality, sentpiece, suffixes, urls, vafile, warc  # noqa: F401
from panelwright.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
