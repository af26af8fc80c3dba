"""Drift analytics and evaluation tables as Spark jobs."""
