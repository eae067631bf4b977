"""All queries of the text problems by name."""

from __future__ import annotations

from . import leaks, mix, pairs, quality, sentence_ops, split, truncation, turns

_MODULES = (sentence_ops, turns, split, pairs, truncation, leaks, mix, quality)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict:
    return {name: q for m in _MODULES for name, q in m.ORACLES.items()}
