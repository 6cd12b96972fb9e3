"""Column expressions."""

from .geometry import arctangent_degrees, linear_degrees, pixels, pixels_per_degree, pixels_to_cm
from .scalars import box_muller, human_format, one_hot, recode, round_up_to_odd, scaled_noise, shifted_labels

__all__ = ["arctangent_degrees", "box_muller", "human_format", "linear_degrees", "one_hot", "pixels", "pixels_per_degree", "pixels_to_cm", "recode", "round_up_to_odd", "scaled_noise", "shifted_labels"]
