"""Batch operators, DataFrame to DataFrame."""
