"""Operators that prepare training text: filtering, de-duplication, mixing, packing, scoring, search."""
