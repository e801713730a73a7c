"""Spark-first engine for raw Bayer frame sequences."""
