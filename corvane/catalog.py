"""All registered queries of the entity-resolution engine and their oracles."""

from __future__ import annotations

from corvane.plans.oracles import ORACLE_SQL
from corvane.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
