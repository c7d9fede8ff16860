"""Interval, point-process and decoding analytics on Spark DataFrames."""
