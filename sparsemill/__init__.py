"""Sparse (row, column, value) triplets with named rows and columns as Spark DataFrames."""
