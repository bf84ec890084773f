"""Colour-negative film scans as Spark tables."""
