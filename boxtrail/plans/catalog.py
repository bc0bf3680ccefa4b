"""All registered queries."""

from boxtrail.plans import grounding_queries, sampling_queries, scoring_queries  # noqa: F401
from boxtrail.plans.registry import ORACLE, QUERIES  # noqa: F401
