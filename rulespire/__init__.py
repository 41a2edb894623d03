"""Explainable rule trees as Spark jobs."""
