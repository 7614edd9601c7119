"""A change-log engine for time series on Spark DataFrames."""
