"""Patch, feature and dataset-integrity analytics expressed as Spark jobs."""

__version__ = "0.1.0"
