"""All queries of the core library by name."""

from __future__ import annotations

from . import artifacts, durable, packing, problems, readings, spans, texts

_MODULES = (problems, spans, texts, packing, readings, durable, artifacts)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict:
    return {name: q for m in _MODULES for name, q in m.ORACLES.items()}
