"""Queries bound to the given tables."""

from __future__ import annotations

import importlib

from . import registry

_MODULES = ["lesion_queries", "raster_queries", "table_queries", "tile_queries", "object_queries"]


def _load():
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries():
    _load()
    return registry.QUERIES


def all_sql():
    _load()
    return registry.ORACLE
