"""Operators of a training-data pipeline: text scoring, deduplication, mixing, search and counting.

Nothing outside this package imports it; the driver contract adds its queries only if it can be imported.
"""
