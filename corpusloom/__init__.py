"""Corpus retrieval and analytics on Spark DataFrames."""
