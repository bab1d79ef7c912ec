"""Operators of the discovery, each from DataFrames to a DataFrame."""
