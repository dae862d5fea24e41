"""A learning-analytics warehouse on Spark: plain functions from DataFrames to lazy DataFrames."""
