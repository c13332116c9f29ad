"""Queries of the library over the driver tables."""
