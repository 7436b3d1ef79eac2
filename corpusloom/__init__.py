"""Corpus analytics on Spark: documents, vectors and link graphs as DataFrames."""

__version__ = "0.1.0"
