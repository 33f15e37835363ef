"""Operators of a training-data pipeline: filtering, deduplication, decontamination, mixing and scoring of text collections.

Nothing outside this subpackage imports it.
"""
