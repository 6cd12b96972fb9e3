"""Unbounded series: what batch operators do, as data arrives."""

from .asof import nearest_asof
from .stateful import decayed_counts, run_lengths
from .windows import gap_sessions, tumbling_features

__all__ = ["decayed_counts", "gap_sessions", "nearest_asof", "run_lengths", "tumbling_features"]
