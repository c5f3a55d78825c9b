"""Queries over the given tables, one or more for every operator, with their SQL."""

from . import frames, handlers, http, messages, metrics, tensors  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
