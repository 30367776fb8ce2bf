"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import importlib

#: Modules here that register queries.
PARTS = ("queries",)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for part in PARTS:
        merged |= getattr(importlib.import_module(f"tallyframe.llm.{part}"), attribute)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
