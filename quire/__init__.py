"""Quire: document-structure operators and training-data operators on Spark DataFrames."""
