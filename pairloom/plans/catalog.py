"""Importing this module registers every query."""

from . import feature_jobs, inventory_jobs, metric_jobs, model_jobs, pair_jobs, point_jobs, quality_jobs, review_jobs, source_jobs  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
