"""Every registered query of the panel library and its SQL twin."""

from __future__ import annotations

from ticklane.plans import indicator_queries, label_queries, ml_queries, portfolio_queries, signal_queries, trade_queries

MODULES = (indicator_queries, signal_queries, trade_queries, portfolio_queries, label_queries, ml_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
