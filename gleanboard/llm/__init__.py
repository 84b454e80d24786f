"""Operators of a large training-data pipeline, each a function from DataFrame to DataFrame."""
