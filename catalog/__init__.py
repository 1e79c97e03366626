"""Every operator over the test tables, each with the SQL that must give the same rows."""

import importlib

MODULES = ["ingest", "features", "sources", "lookup", "profile", "evaluate", "monitor", "streams", "models"]


def load_all():
    """Import every query module; returns (queries, oracle texts)."""
    from catalog import base

    for module in MODULES:
        importlib.import_module(f"catalog.{module}")
    return base.QUERIES, base.ORACLES
