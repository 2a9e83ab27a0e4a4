"""Search and statistics over annotated text collections, as plain functions on Spark DataFrames."""
