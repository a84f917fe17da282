"""All registered queries; importing the plan modules fills the registry."""

from chainweft.plans import activity, detect, evidence, graph, matching, risk, scope, streams, visibility  # noqa: F401
from chainweft.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
