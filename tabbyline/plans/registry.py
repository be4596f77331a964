"""All queries of the core, with the SQL that gives the same rows."""

from tabbyline.plans import chunks, corpus, pages, retrieval  # noqa: F401  (they register their queries)
from tabbyline.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
