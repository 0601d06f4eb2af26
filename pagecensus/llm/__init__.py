"""Operators of a training-data pipeline: deduplication, tokenization, scoring, privacy, packing.

Each operator module has a general interface on DataFrames; ``queries`` applies the operators to the
whole corpus tables. Nothing outside this subpackage imports it.
"""
