"""Registered queries: each maps (spark, sf_dir) to a DataFrame, most with a SQL check."""

from __future__ import annotations

import importlib
import pkgutil

from larder.catalog.registry import CHECKS, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "registry":
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["CHECKS", "QUERIES"]
