"""All registered queries."""

from . import asof_queries, event_queries, family_queries, feature_queries, position_queries, profile_queries, resample_queries, selection_queries, source_queries, stat_queries, stop_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
