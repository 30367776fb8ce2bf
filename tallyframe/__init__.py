"""Retail metrics, text matching, entity resolution, profiling, comparison,
evaluation, SQL-log audit and event operators, all as Spark DataFrames."""
