"""The functions of the expression language, in packs; importing this registers them all."""

from ..plans.planner import REGISTRY
from . import aggregates, dates, nested, scalars, sequences, shifts  # noqa: F401

__all__ = ["REGISTRY"]
