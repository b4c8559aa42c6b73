"""Corpus curation and evaluation operators on Spark DataFrames."""
