"""All catalogue queries, collected from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

MODULES = ("tracking", "statistics", "rain", "radar", "moving", "climatology", "grids", "clouds", "periodic", "extras", "runs")


def query(name: str, oracle: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


for _module in MODULES:
    importlib.import_module(f"catalog.{_module}")
