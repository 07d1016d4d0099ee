"""Sextant: point-in-time market analytics as Spark DataFrame jobs."""
