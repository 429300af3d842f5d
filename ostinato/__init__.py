"""Sequence analytics and training-data operators on Spark."""
