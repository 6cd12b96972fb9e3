"""Named annotation methods: any DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_METHODS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, method: Callable[..., DataFrame] | None = None) -> Callable:
    """Add a method, also as a decorator."""
    if method is None:
        return lambda f: register(name, f)
    _METHODS[name] = method
    return method


def registered() -> list[str]:
    return sorted(_METHODS)


def annotate(df: DataFrame, method: str, **options) -> DataFrame:
    """``df`` with the labels of a method; an unknown one fails."""
    if method not in _METHODS:
        raise ValueError(f"unknown annotation method: {method}; there are {registered()}")
    return _METHODS[method](df, **options)
