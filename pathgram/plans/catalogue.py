"""All registered queries."""

from pathgram.plans import data_queries, model_queries, nonlinear_queries, resample_queries, tree_queries  # noqa: F401
from pathgram.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
