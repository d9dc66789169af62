"""Tidemark: declared, keyed and time-valid data as typed views over Spark DataFrames."""
