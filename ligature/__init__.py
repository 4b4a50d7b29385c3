"""Ordered-sequence clustering, boundary analytics and corpus preparation on Spark DataFrames."""
