"""Ranked, token-budgeted retrieval and text analytics over Spark DataFrames."""
