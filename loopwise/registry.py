"""The registered queries of the route library and their SQL."""

from loopwise.plans import network, places, queries  # noqa: F401
from loopwise.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
