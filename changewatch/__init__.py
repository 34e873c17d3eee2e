"""Monitoring of document collections over time, on Spark DataFrames."""
