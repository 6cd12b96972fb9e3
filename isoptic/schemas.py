"""Explicit schemas of the tables that recordings become."""

from __future__ import annotations

GAZE_RAW = "recording_id string, idx long, t_us double, left_x double, left_y double, right_x double, right_y double"
MESSAGES = "recording_id string, seq int, t_us double, text string"
RECORDINGS = "recording_id string, participant string, grp string, task string, dom_eye string, header string"
PANELS = "participant string, task string, panel string, strike_score double, recording_date timestamp, lo double, hi double, duration double"
GAZE = "participant string, task string, panel string, idx long, t double, x double, y double"
DEGREE_RECORD = "t double, x double, y double, evt int, status int, x_original double, y_original double"
TRAINING_RECORD = "t double, x float, y float, status short, evt short"
FIXATION = "t double, eye_horizontal double, eye_vertical double, status double, evt double"
AUDIO_EVENT = "t double, signal_index long, sentence_breaks int"
RELIABILITY = "subject string, pos int, v double"
