"""Registered demonstration queries, each with an independent SQL statement where one exists."""

from assayline.queries import (  # noqa: F401 - importing registers the queries
    cleaning_queries,
    evaluation_queries,
    feature_queries,
    model_queries,
    profile_queries,
    scoring_queries,
    source_queries,
)
from assayline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
