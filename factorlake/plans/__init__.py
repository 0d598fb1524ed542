"""Registered queries over the driver tables."""

import importlib

MODULES = ("series", "evaluation", "library", "barlake", "portfolio", "journal", "panelops", "single", "streams")


def load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
