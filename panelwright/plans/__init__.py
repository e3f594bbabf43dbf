"""Registered queries. Importing the modules fills the registries."""

from panelwright.plans import mixed, models, panel, rows  # noqa: F401
from panelwright.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
