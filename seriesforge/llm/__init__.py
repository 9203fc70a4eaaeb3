"""Operators for preparing training data at scale: deduplication, filtering, mixing, tokenizing.

Nothing else in the package imports this subpackage; it uses only the general session helpers.
Every operator selects the id and content columns it is told to use into names of its own, so
extra columns, also with clashing names, never matter.
"""
