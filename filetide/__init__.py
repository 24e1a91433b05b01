"""File-estate analytics on Spark.

Inventory tables in, answers as DataFrames out. See README.md for the map of
"""
