"""Queries over the data tables, one module per family, each with ``queries()`` and ``oracle_sql()``."""
