"""Compositions: fixpoints, poolers, hierarchies."""
