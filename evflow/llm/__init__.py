"""Operators of a training-data pipeline, one module each, and the registry of their queries."""
