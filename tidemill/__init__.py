"""Tidemill: time-series analytics on Spark DataFrames."""
