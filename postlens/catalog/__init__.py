"""Queries registered for the driver."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``*_queries`` module, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
