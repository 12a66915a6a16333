"""Every query of the engine by name, with the SQL that gives the same rows."""

from . import catalog, jobs, lookup, retrieval, text

QUERIES: dict = text.QUERIES | retrieval.QUERIES | lookup.QUERIES | catalog.QUERIES | jobs.QUERIES
SQL: dict[str, str] = text.SQL | retrieval.SQL | lookup.SQL | catalog.SQL | jobs.SQL
