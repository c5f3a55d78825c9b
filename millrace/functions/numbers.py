"""Whole-number arithmetic."""

from pyspark.sql import functions as F


def divided(column, by):
    """Whole quotient of two BIGINTs; unlike ``/`` it is exact beyond 2^53."""
    return F.call_function("div", column, F.lit(by))
