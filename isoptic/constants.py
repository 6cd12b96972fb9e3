"""Fixed values of the recordings and of the two reading tasks."""

from __future__ import annotations

import math

# Screen, in pixels, and the geometry of a session, in metres.
SCREEN_WIDTH, SCREEN_HEIGHT = 1920, 1080
METRES_PER_PIXEL = 0.000264583
VIEW_DISTANCE = 0.65
DEGREES_PER_PIXEL = 2 * math.degrees(math.atan((METRES_PER_PIXEL / 2) / VIEW_DISTANCE))

# Event codes.
UNDEFINED, FIXATION, SACCADE, PSO, PURSUIT, BLINK, OTHER = 0, 1, 2, 3, 4, 5, 9
EVENT_NAMES = {0: "undefined", 1: "fixation", 2: "saccade", 3: "pso", 4: "pursuit", 5: "blink", 9: "other"}

# Sampling.
SAMPLE_RATE = 600
SAMPLE_RATES = (2000, 1250, 1000, 600, 500, 300, 250, 240, 200, 120, 75, 60, 50, 30, 25)
DEFAULT_RECORDING_DATE = "2024-07-01"

# Cleaning and labelling.
OUTLIER_FACTOR = 8.0
MAX_MISSING_SHARE = 0.1
SMOOTHING_MS = 15
SACCADE_MIN_VELOCITY = 15.0
SACCADE_MAX_ANGLE = 30.0
MIN_FIXATION_SECONDS = 0.01

# Speech.
RMS_FRAME, RMS_HOP = 8192, 2048
NOISE_LIMIT = 0.01
MIN_SPEECH_SECONDS = 0.25

# Sequences.
SEQUENCE_LENGTH, STRIDE = 200, 50
SHUFFLE_SEED = 220617

# Heat maps.
HEAT_DECAY, HEAT_FRAMES, BLUR_SIGMA = 0.99, 54_000, 3.0

# Messages that open and close a panel.
PANEL_MESSAGES = {
    "SDMT": (("panel number 1", "panel number 2", "panel number 3"), ("break panel number 1", "break panel number 2", "finished")),
    "KD": (("slide 1", "slide 3", "slide 5"), ("slide 2", "slide 4", "done with slides")),
}

# Centres of the targets: columns and rows of a regular grid, in pixels.
GRID_LEFT, GRID_RIGHT, GRID_COLUMNS = 537, 1379, 15
GRID_TOP, GRID_BOTTOM, GRID_ROWS = 296, 1034, 8
KEY_AREA_BOTTOM = 0.142
