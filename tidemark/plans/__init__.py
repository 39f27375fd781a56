"""Pipelines over the test tables: one registered query per operator."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    for module in sorted(m.name for m in iter_modules(__path__)):
        if module.startswith("q_"):
            import_module(f"{__name__}.{module}")
