"""Operators for the preparation of training data; nothing else in the package imports this one."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["history", "language", "lookalikes", "neardup", "packing", "pairs", "scans", "tokens", "truncation"]


def _modules() -> list:
    return [import_module(f"{__name__}.{m}") for m in _MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
