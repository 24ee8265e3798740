"""Registered queries of the core: each with the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

import importlib
import pkgutil

FLAGSHIP = "rfm_segments"


def _modules():
    for found in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{found.name}")


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.oracle_sql().items()}
