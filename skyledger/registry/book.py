"""Collects the entries of all query modules."""

from skyledger.registry import (  # noqa: F401
    cleaning, climate, evaluation, features, files, joins, models,
)
from skyledger.registry.entries import QUERIES

__all__ = ["QUERIES"]
