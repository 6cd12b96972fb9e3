"""From screen shares to pixels, degrees and centimetres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def pixels(x: Column, y: Column) -> tuple[Column, Column]:
    """Shares of the screen in pixels."""
    return x * C.SCREEN_WIDTH, y * C.SCREEN_HEIGHT


def linear_degrees(x: Column, y: Column, per_pixel: float = C.DEGREES_PER_PIXEL) -> tuple[Column, Column]:
    """Degrees from the screen's centre by a constant angle for a pixel."""
    px, py = pixels(x, y)
    return (px - C.SCREEN_WIDTH / 2) * per_pixel, (py - C.SCREEN_HEIGHT / 2) * per_pixel


def arctangent_degrees(pixel: Column, middle: Column | float, metres: float = C.METRES_PER_PIXEL, distance: float = C.VIEW_DISTANCE) -> Column:
    """Degrees between a pixel and the middle of an image, seen from ``distance``."""
    return F.degrees(F.atan2((pixel - middle) * metres, F.lit(distance)))


def pixels_per_degree(width: Column, height: Column, width_px: Column, height_px: Column, distance: Column) -> Column:
    """Mean over both axes, from the screen's size and distance in one unit."""
    one = lambda size, px: 1 / (F.degrees(2 * F.atan(size / (2 * distance))) / px)
    return (one(width, width_px) + one(height, height_px)) / 2


def pixels_to_cm(px: Column, metres: float = C.METRES_PER_PIXEL) -> Column:
    return px * metres * 100
