"""Scalar and closed functions as Columns."""
