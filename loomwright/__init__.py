"""A PySpark-native analytics and feature-engineering engine."""

__version__ = "0.1.0"
