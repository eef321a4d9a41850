"""Structured Streaming extensions (the reference data flow has no streams)."""
