"""Operators for cleaning, scoring and packing language-model training text.

Nothing outside this package imports it; it can be deleted as a whole.
"""
