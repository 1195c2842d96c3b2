"""Sequence and signal analytics on Spark."""
