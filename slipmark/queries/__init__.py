"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from slipmark.queries.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
