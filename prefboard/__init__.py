"""Preference-evaluation analytics on Spark DataFrames."""
