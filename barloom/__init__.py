"""Causal price-bar analytics on Spark DataFrames."""
