"""The registered queries and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "texts", "joins", "aggregates", "search", "changes", "packages", "streams")


def _all(attribute: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"claimloom.plans.{m}"), attribute)
    return found


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict:
    return _all("SQL")
