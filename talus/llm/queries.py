"""Importing this module registers every query of the subpackage."""

from talus.llm import queries_chat, queries_filter, queries_near, queries_pages, queries_tokens, queries_training  # noqa: F401
from talus.llm.registry import ORACLES, QUERIES  # noqa: F401
