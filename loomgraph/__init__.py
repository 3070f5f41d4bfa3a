"""Property-graph analytics on PySpark: typed graphs as DataFrames, patterns as joins."""
