"""Training-data operators: filters, near-duplicates, extraction, packing, tokens and language models.

Nothing outside this folder imports it. `load()` gives the registered queries.
"""

import importlib


def load():
    return importlib.import_module(f"{__name__}.queries")
