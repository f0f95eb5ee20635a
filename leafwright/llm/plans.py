"""Queries of the text operators with their SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("plans_repair", "plans_quantiles", "plans_looks", "plans_pieces", "plans_tokens", "plans_spans")


def _modules() -> list:
    return [importlib.import_module(f"leafwright.llm.{n}") for n in FAMILIES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.oracle_sql().items()}
