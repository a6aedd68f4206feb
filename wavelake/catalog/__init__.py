"""Registered queries with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from wavelake.catalog.registry import ORACLES, QUERIES


def load_catalog():
    """Imports every catalog module once and returns (queries, SQL twins)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
