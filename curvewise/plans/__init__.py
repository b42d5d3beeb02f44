"""Registered queries: each operator run over whole driver tables, with its SQL twin."""

from curvewise.plans import curve_queries, model_queries, summary_queries, table_queries, trait_queries
from curvewise.plans.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "curve_queries",
    "model_queries",
    "summary_queries",
    "table_queries",
    "trait_queries",
]
