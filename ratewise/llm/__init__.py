"""Operators that prepare training text, and their registered queries."""

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
