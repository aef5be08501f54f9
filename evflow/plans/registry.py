"""Every query of the event operators, with its SQL."""

from __future__ import annotations

from evflow.plans import aggregate_queries, evaluation_queries, feature_queries, further_queries, grid_queries, model_queries, nested_queries, scalar_queries, selection_queries, study_queries  # noqa: F401
from evflow.plans.catalog import ORACLE_SQL, QUERIES  # noqa: F401
