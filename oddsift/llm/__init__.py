"""Operators for preparing training data: scoring, filtering, de-duplicating, tokenising, packing, searching.

Nothing else in the package imports this one, so it can be removed as a whole.
"""
