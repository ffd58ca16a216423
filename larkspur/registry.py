"""Every query for the library's own operators, with the SQL that gives the same rows."""

from larkspur.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "eval_summary"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
