"""Echolot: a PySpark-native engine that finds duplicate recordings and other repeated sequences."""

__version__ = "0.1.0"
