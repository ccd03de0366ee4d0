"""Event-lifecycle analytics on Spark DataFrames."""
