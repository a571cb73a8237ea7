"""Registered queries and their SQL counterparts."""

from __future__ import annotations


def _modules():
    import importlib
    names = ("region_queries", "assay_queries", "model_queries", "network_queries")
    return [importlib.import_module(f"regweave.catalog.{n}") for n in names]


def queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
