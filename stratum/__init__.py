"""Structural and retrieval analytics on Spark DataFrames."""
