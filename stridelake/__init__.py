"""Stridelake: motion and ordered-series analytics on Spark DataFrames."""
