"""Tessera: ranked retrieval, graph, rule, policy and usage analytics over text corpora, as Spark DataFrames."""

__version__ = "0.1.0"
