"""Similarity search, copy detection and data preparation on Spark DataFrames."""
