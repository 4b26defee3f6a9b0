"""Argolith: discussion analytics as DataFrame-to-DataFrame transformations on Spark."""

__version__ = "0.1.0"
