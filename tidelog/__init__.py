"""Versioned change-log analytics on Spark DataFrames."""
