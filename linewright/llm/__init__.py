"""Operators of a training-data pipeline: cleaning, scoring, deduplication, mixing, encoding, search.

Nothing else in the library imports this package.
"""
