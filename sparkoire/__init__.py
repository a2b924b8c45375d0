"""Immune repertoire analytics and training-data preparation on Spark DataFrames."""
