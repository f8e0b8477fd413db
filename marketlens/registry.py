"""Queries of the lead and market operators with their SQL oracles."""

import importlib

MODULES = ("operators.captured", "operators.keys", "operators.leads", "operators.ledger", "operators.lexicon", "operators.matching", "operators.pages", "operators.pricing", "operators.regions", "operators.retention", "operators.runs", "operators.stores", "operators.variants", "streaming.jobs")


def _all():
    found = {}
    for m in MODULES:
        found.update(importlib.import_module(f"marketlens.{m}").build())
    return found


def queries():
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark, sf_dir):
    """Market statistics, confidence and balanced price per product."""
    return queries()["prc2_5_market_statistics"](spark, sf_dir)
