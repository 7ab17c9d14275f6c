"""Tessera: filtered similarity search and document analytics on Spark DataFrames."""
