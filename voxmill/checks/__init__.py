"""Queries over the shared test tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

_MODULES = ["cleaning", "sources", "themes", "views", "vectors", "streams"]


def all_checks() -> ModuleType:
    """The registry with every check in it."""
    for name in _MODULES:
        import_module(f"voxmill.checks.{name}")
    return import_module("voxmill.checks.registry")
