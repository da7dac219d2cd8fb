"""Correspondence-archive analytics and training-data operators on Spark."""
