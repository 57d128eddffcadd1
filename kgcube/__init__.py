"""Contextualised knowledge-graph cubes as Spark DataFrames."""
