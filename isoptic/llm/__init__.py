"""Operators for preparing training text at scale.

Nothing outside this package imports it; it can be removed as a whole.
"""
