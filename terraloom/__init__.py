"""Spark-native analytics for surveyed space: points, rasters, polygons and world graphs."""

__version__ = "0.1.0"
