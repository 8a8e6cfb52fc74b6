"""Paged-document analytics on Spark DataFrames."""
