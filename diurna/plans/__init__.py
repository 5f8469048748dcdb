"""Plans: operators wired to the carrier views, one module per family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
