"""Parity predicates, time-ordered identifiers, reference data and corpus operators on Spark."""
