"""One query per operator over the test tables, with a SQL twin where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("sources", "decode", "checks", "relations", "vision", "streams")


def load_all():
    """(queries, oracles) of every recipe module, in inventory order."""
    from framelake.recipes import tables

    for module in MODULES:
        importlib.import_module(f"framelake.recipes.{module}")
    return tables.QUERIES, tables.ORACLES
