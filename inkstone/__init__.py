"""Extractive text analytics on Spark DataFrames."""
