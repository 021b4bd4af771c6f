"""Operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

MODULES = ("simhash", "langid", "chat", "substring", "mixing", "decontaminate", "toxicity", "exact", "tokens", "quality")


def _loaded():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    """The thin contract queries opN_<name>, in the order of N."""
    found = {k: f for m in _loaded() for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _loaded() for k, v in getattr(m, "SQL", {}).items()}
