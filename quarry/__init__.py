"""Governed object analytics on Spark."""
