"""Change-history analytics and corpus preparation on Spark DataFrames."""
