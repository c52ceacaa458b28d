"""All queries of the subpackage; importing the q_* modules fills the registry."""

from __future__ import annotations

from . import q_bpe, q_chat, q_langid, q_lexical, q_lines, q_merkle, q_mixing, q_neardup, q_ngram, q_packing, q_search, q_suffix, q_tokens  # noqa: F401
from .common import ORACLES, QUERIES, QueryFn


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
