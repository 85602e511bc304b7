"""Jobs for large collections of multi-sensor recordings, on Spark DataFrames."""
