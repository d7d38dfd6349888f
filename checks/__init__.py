"""The registered queries, and the same questions in plain SQL for a second engine."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("cleaning", "search", "reports", "conversations", "tables", "models")


def load():
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
