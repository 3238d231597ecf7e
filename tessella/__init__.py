"""Tessella: array, feature and graph analytics for Spark DataFrames."""

__version__ = "0.1.0"
