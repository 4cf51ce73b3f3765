"""Shared by the tests."""

from __future__ import annotations


def rows(df, *columns):
    """Sorted rows of a DataFrame as tuples."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
