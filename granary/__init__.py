"""Granary: a demand-panel engine written as lazy Spark plans."""

__version__ = "0.1.0"
