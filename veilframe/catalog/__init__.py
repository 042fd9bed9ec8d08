"""Registered queries over the given tables, with the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("detection", "policies", "access", "requests", "whole", "records", "trail", "streams")


def _merged(kind: str) -> dict:
    merged: dict = {}
    for part in _PARTS:
        for name, value in getattr(import_module(f"veilframe.catalog.{part}"), kind).items():
            if name in merged:
                raise ValueError(f"query registered twice: {name}")
            merged[name] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
