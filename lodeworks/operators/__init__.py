"""Joins, groupings, rankings, duplicates, retrieval, evaluation and study reports over DataFrames."""
