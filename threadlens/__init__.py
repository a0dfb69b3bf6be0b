"""User profiling and thread explanation on Spark DataFrames."""
