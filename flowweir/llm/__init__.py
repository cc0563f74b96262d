"""Operators of a training-data pipeline, their queries and their SQL checks.

Nothing outside this package imports it.
"""
