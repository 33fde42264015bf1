"""Spatial single-cell analytics expressed as Spark DataFrame jobs."""
