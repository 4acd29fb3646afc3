"""All queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and the SQL that must agree."""

from __future__ import annotations

from chronoweave.plans import clinical_queries, relational_queries, temporal_queries, text_queries  # noqa: F401
from chronoweave.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
