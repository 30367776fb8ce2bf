"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

import importlib

_PARTS = ("retail", "primitives", "text", "resolution", "results", "evaluation", "sqllog", "eventlog", "sources")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for part in _PARTS:
        module = importlib.import_module(f"tallyframe.catalog.{part}")
        for name, value in getattr(module, attribute).items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
