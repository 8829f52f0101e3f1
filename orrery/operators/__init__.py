"""Constraints that a table must hold, and the registry of versioned extensions."""

from .constraints import assert_valid, violations
from .registry import Registry

__all__ = ["Registry", "assert_valid", "violations"]
