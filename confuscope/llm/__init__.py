"""Operators for preparing training data: filtering, deduplication, PII, packing and token output.

Nothing outside this subpackage imports it.
"""
