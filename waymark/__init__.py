"""Waymark: shortest-path and trace analytics on Spark DataFrames."""
