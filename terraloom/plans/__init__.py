"""Registered queries; importing the modules fills the registry."""

from terraloom.plans.registry import ORACLES, QUERIES
from terraloom.plans import ecology, imagery, studies, tabular, vector, water  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
