"""Spark-native analytics for gridded, spatial and time-stamped observations."""

__version__ = "0.1.0"
