"""Ledger analytics expressed as ordinary Spark DataFrames."""
