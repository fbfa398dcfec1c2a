"""Temporal payment-graph analytics on Spark DataFrames."""
