"""All queries of the library, by importing the modules that register them."""

from tidemark.plans import calibrated, definitions, engine, events, prepare, state, verify
from tidemark.plans.registry import ORACLES, QUERIES

MODULES = (prepare, verify, state, events, engine, calibrated, definitions)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
