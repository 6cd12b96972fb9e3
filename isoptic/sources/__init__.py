"""Readers and writers."""

from .files import (
    allowed,
    config,
    directories,
    fixation_csv,
    fixations,
    image_shapes,
    listed,
    npy_records,
    parsed,
    recording_date,
    wav_info,
    wav_samples,
)
from .sinks import append_missing, write_checkpoint, write_csv, write_json, write_npy, write_records

__all__ = ["allowed", "append_missing", "config", "directories", "fixation_csv", "fixations", "image_shapes", "listed", "npy_records", "parsed", "recording_date", "wav_info", "wav_samples", "write_checkpoint", "write_csv", "write_json", "write_npy", "write_records"]
