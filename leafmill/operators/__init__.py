"""Operators on pages, outlines, stores and conversations: DataFrames in, DataFrames out."""
