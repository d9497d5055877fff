"""Importing this module registers every query of the package."""

from lodestar.llm import (archive, embeddings, exact_dedup, filter_audit, jaccard, language, mixing, packing, pii,  # noqa: F401
                          quality, substring, templates, turn_trie)
from lodestar.llm.base import ORACLE, QUERIES  # noqa: F401
