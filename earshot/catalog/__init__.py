"""Every registered query, and its checking SQL where there is one."""

from earshot.catalog.registry import ORACLES, QUERIES
from earshot.catalog import ask_queries, label_queries, ledger_queries, report_queries, source_queries, stats_queries, text_queries, vector_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
