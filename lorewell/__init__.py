"""Corpus analytics and retrieval on Spark DataFrames."""
