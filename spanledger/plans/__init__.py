"""Named queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every plan module so that it registers its queries."""
    from spanledger.plans import catalog

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return catalog
