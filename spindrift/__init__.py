"""Spindrift: ranked retrieval, link and term analytics as Spark logical plans."""

__version__ = "0.1.0"
