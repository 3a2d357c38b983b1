"""Interval algebra, sparse-matrix aggregation and data preparation on PySpark DataFrames."""
