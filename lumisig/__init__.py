"""Similarity search over wavelet image signatures, on Spark DataFrames."""
