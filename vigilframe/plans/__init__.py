"""All registered queries; importing a family module registers its entries."""

from vigilframe.plans import aggregates, expressions, learning, lookups, scalar, sets, storage, streams, topk, windows  # noqa: F401
from vigilframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
