"""The expected results, as SQL over the raw test tables."""

from ledgerline_expected.sql import oracle_sql

__all__ = ["oracle_sql"]
