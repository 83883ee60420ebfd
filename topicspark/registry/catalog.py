"""All registered queries and their check SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("records", "texts", "joins", "sources", "mining", "models", "streams")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        merged.update(getattr(importlib.import_module(f"{__package__}.{family}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
