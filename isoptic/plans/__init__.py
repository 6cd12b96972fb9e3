"""Whole analyses, composed of operators."""

from .analyses import clean_recording, declaration_shares, distance_from_targets, label_recording, sequence_windows, speech_timing
from .registry import annotate, register, registered

__all__ = ["annotate", "clean_recording", "declaration_shares", "distance_from_targets", "label_recording", "register", "registered", "sequence_windows", "speech_timing"]
