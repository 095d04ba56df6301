"""Registered queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

import inspect

from shroud.plans import queries as _queries
from shroud.plans import queries_tables as _tables
from shroud.plans import sql as _sql
from shroud.plans.sql_guard import GUARD_SQL
from shroud.plans.sql_headers import HEADERS_SQL
from shroud.plans.sql_nested import NESTED_SQL
from shroud.plans.sql_records import RECORDS_SQL
from shroud.plans.sql_tables import TABLES_SQL

QUERIES = {name: f for module in (_queries, _tables) for name, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_") and name != "t"}

ORACLE_SQL = _sql.ORACLE_SQL | NESTED_SQL | RECORDS_SQL | HEADERS_SQL | GUARD_SQL | TABLES_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
