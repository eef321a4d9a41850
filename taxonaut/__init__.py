"""Taxonomy analytics on Spark."""
