"""Queries over the given tables, one per operator, with reference SQL where SQL can say it."""

from __future__ import annotations


def load_all():
    """All registered queries and all reference SQL, by name."""
    import importlib
    import pkgutil

    from . import core

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return core.QUERIES, core.ORACLES
