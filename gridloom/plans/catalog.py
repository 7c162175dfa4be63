"""All registered queries. Importing the plan modules fills the registry."""
from __future__ import annotations

import importlib
import pkgutil

import gridloom.plans as plans
from gridloom.plans.registry import ENTRIES, runner

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.startswith("q_"):
        importlib.import_module(f"gridloom.plans.{_module}")


def queries() -> dict:
    return {name: runner(entry) for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}
