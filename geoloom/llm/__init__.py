"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it. The queries over the standard tables
are in :mod:`geoloom.llm.registry`.
"""
