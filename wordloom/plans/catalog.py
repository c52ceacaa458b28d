"""All registered queries; importing the q_* modules fills the registry."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

_MODULES = [
    "q_lexicon",
    "q_prep",
    "q_sampling",
    "q_eval",
    "q_features",
    "q_models",
    "q_ml",
    "q_io",
]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
