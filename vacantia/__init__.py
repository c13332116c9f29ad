"""Vacantia: Spark operators for building, scoring and serving a registry of listings."""

__version__ = "0.1.0"
