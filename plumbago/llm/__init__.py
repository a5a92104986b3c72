"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this folder imports it. Every operator takes DataFrames, keeps
its own general interface (column names and thresholds are parameters) and
leaves partitioning and shuffles to Spark.
"""
