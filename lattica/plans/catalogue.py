"""Queries and their DuckDB counterparts, by name."""

from lattica.plans import queries
from lattica.plans.oracles import ORACLES

#: Queries without SQL: models fitted in tasks.
WITHOUT_SQL = ("wf_simple", "wf_ensembles", "wf_nested_rolling", "wf_nested_expanding")

QUERIES = {name: getattr(queries, name) for name in (*ORACLES, *WITHOUT_SQL)}

__all__ = ["ORACLES", "QUERIES", "WITHOUT_SQL"]
