"""All queries of the subpackage; importing this module registers them."""

from __future__ import annotations

from auditlake.llm import dialogue, divergence, langid, lines, media, minmax, mixing, pieces, secrets, simhash, substrings, tokens, warc  # noqa: F401
from auditlake.llm.registry import ORACLE_SQLS, QUERIES

__all__ = ["ORACLE_SQLS", "QUERIES"]
