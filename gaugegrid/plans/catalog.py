"""Import every plan module so that all queries are registered."""

from gaugegrid.plans import audit_plans, feature_plans, model_plans, pair_plans, pattern_plans, score_plans  # noqa: F401
from gaugegrid.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
