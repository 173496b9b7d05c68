"""Weighted multi-pattern scanning and risk analytics as Spark jobs."""
