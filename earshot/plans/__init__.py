"""Registered queries: operators bound to the test tables, each with its SQL check."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``*_queries`` module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
