"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from tradeweft.checks.base import CHECKS, oracle, run

_MODULES = ("rollups", "state", "learning", "chain", "streams", "plans", "sinks")


def names() -> list[str]:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
    return list(CHECKS)


__all__ = ["names", "oracle", "run"]
