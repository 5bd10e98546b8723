"""Operators for preparing training corpora: cleaning, deduplication, search, mixing and packing.

Nothing outside this subpackage imports it. Its queries and their SQL are in ``queries``.
"""
