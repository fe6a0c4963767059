"""Anchored-junction and interval analytics on Spark DataFrames."""
