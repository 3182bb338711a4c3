"""Astronomical time-series analytics on Spark."""
