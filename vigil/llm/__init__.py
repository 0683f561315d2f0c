"""Corpus operators for training-data pipelines, on Spark DataFrames."""
