"""Spectral retrieval analytics on Spark DataFrames."""
