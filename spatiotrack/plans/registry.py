"""All queries of the library's own operators, and their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tracking", "calibration", "evaluation", "diagnostics", "zones")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLES.items()}
