"""Importing this module registers every query."""

import importlib

from factledger.plans.registry import ORACLES, QUERIES

FAMILIES = (
    "state_queries",
    "normalize_queries",
    "search_queries",
    "load_queries",
    "identity_queries",
    "bulk_queries",
    "catalog_queries",
    "proof_queries",
    "stream_queries",
)

for family in FAMILIES:
    importlib.import_module(f"factledger.plans.{family}")

__all__ = ["ORACLES", "QUERIES"]
