"""Named queries and their SQL oracles."""

from __future__ import annotations

from quillstream.plans import citations, nested, records, store

MODULES = [nested, store, citations, records]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
