"""Loomtext: ranked text retrieval and document-collaboration analytics, declared on PySpark DataFrames."""
