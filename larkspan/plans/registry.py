"""Named queries and the SQL that they are checked against."""

from larkspan.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
